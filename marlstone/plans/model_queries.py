"""Queries of growth over years, recursion by derived features, training rows, focused chunks and market data, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import company, forecast, market, panel
from marlstone.operators import docs as documents
from marlstone.plans.queries import PANEL, W, _section_chunks_sql, company_panel, query, r, table


@query("""
    with d as (select o_orderpriority, o_orderdate as date, arg_max(o_totalprice, o_orderkey) as close from orders group by 1, 2),
    y as (select o_orderpriority, cast(year(date) as integer) as year, arg_max(close, date) as close_last, count(*)::double as volume_sum from d group by 1, 2)
    select o_orderpriority, year, close_last, volume_sum, round((close_last / nullif(lag(close_last) over (partition by o_orderpriority order by year), 0) - 1) * 100, 4) as growth_yoy_pct from y
""")
def yearly_growth(spark, sf_dir):
    """Orders of a priority as an instrument: a day's close is the last order's price."""
    daily = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.col("o_orderdate").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close")).withColumn("volume", F.lit(1.0))
    return market.yearly(daily, ["o_orderpriority"]).select("o_orderpriority", "year", "close_last", "volume_sum", r("growth_yoy_pct"))


@query(f"""
    with recursive p as ({PANEL}), l as (select *, lag(revenue_current) {W} as a, lag(revenue_current, 2) {W} as b, row_number() over (partition by symbol order by year desc) as k from p),
    w(symbol, year, v, a, b, n) as (
        select symbol, 2001, revenue_current, a, b, 0 from l where k = 1 union all
        select symbol, year + 1, (v + coalesce(a, 0) + coalesce(b, 0)) / 3 + case when coalesce(a, 0) <> 0 then (v - a) / abs(a) * 100 else 0 end, v, a, n + 1 from w where n < 4)
    select symbol, cast(year as integer) as year, round(v, 3) as revenue from w
""")
def recursive_derived(spark, sf_dir):
    """Four years on from a customer's last one; each year's step reads features that are derived from the state before it."""
    p, by = company_panel(spark, sf_dir), panel.by_symbol()
    lagged = p.withColumns({"revenue_lag1": F.lag("revenue_current").over(by), "revenue_lag2": F.lag("revenue_current", 2).over(by)})
    last = lagged.groupBy("symbol").agg(F.max_by(F.struct("revenue_current", "revenue_lag1", "revenue_lag2"), "year").alias("s")).select("symbol", "s.*")
    base = last.withColumn("profit_after_tax", F.lit(0.0)).withColumns({f"profit_lag{k}": F.lit(None).cast("double") for k in (1, 2)})
    step = lambda s, year: s.withColumns({"revenue_next": F.col("revenue_roll3_mean") + F.col("revenue_momentum_pct"), "profit_next": F.lit(0.0)})
    return forecast.recursive(base, step, 2001, 2005).select("symbol", "year", r("revenue", 3))


@query(f"""
    with p as ({PANEL}), l as (select *, case when coalesce(lag(revenue_current) {W}, 0) <> 0 then (revenue_current / lag(revenue_current) {W} - 1) * 100 else 0 end as yoy, lead(revenue_current) {W} as next from p),
    u as (select *, year + 1 as ty from l where next is not null and revenue_current <> 0), t as (select * from u where ty <= 1998), b as (select quantile_cont(yoy, 0.01) as lo, quantile_cont(yoy, 0.99) as hi, max(ty) as z from t)
    select 'train' as part, cast(ty as integer) as target_year, count(*) as n, round(sum(0.35 + 0.65 * power(0.8, z - ty)), 4) as weight, round(max(lo), 4) as low, round(max(hi), 4) as high, round(sum(least(greatest(yoy, lo), hi)), 2) as clipped_sum from t, b group by ty
    union all select 'test', 1999, count(*), cast(count(*) as double), round(max(lo), 4), round(max(hi), 4), round(sum(least(greatest(yoy, lo), hi)), 2) from u, b where ty = 1999
""")
def batch_training_rows(spark, sf_dir):
    """What a batch forecast trains on and predicts: rows and weights by year, and the bounds learnt from the training rows alone."""
    p = company_panel(spark, sf_dir)
    rows = p.withColumns(panel.trend_features(p, "revenue_current", "revenue")).withColumns({"revenue_next": F.lead("revenue_current").over(panel.by_symbol()), "target_year": F.col("year") + 1})
    usable = forecast.targets(rows, "revenue_current", "revenue_next")
    train = usable.where("target_year <= 1998")
    bundle = forecast.Bundle(None, ["revenue_yoy_pct"], panel.clip_bounds(train, ["revenue_yoy_pct"]))
    first, last = train.agg(F.min("target_year"), F.max("target_year")).first()
    low, high = bundle.clip_bounds["revenue_yoy_pct"]
    both = bundle.prepared(train, None).select(F.lit("train").alias("part"), "target_year", panel.recency_weight(F.col("target_year"), first, last).alias("w"), "revenue_yoy_pct")
    both = both.unionByName(bundle.prepared(usable.where("target_year = 1999"), None).select(F.lit("test").alias("part"), "target_year", F.lit(1.0).alias("w"), "revenue_yoy_pct"))
    sums = both.groupBy("part", "target_year").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("weight"), F.round(F.sum("revenue_yoy_pct"), 2).alias("clipped_sum"))
    return sums.select("part", "target_year", "n", "weight", F.round(F.lit(low), 4).alias("low"), F.round(F.lit(high), 4).alias("high"), "clipped_sum")


#: Headings put above documents, by language.
HEADED = {"en": "QUẢN TRỊ RỦI RO", "de": "Kế hoạch 2026:", "fr": "CHƯƠNG 6 PHÁT TRIỂN BỀN VỮNG"}
_HEADED_SQL = f"(select doc_id, case lang {' '.join(f"when '{k}' then '{v}' || chr(10)" for k, v in HEADED.items())} else '' end || text as text from documents)"


@query(_section_chunks_sql(_HEADED_SQL, focus=True))
def focused_chunks(spark, sf_dir):
    """Chunks of the categories that reports are read for. Documents get a heading by their language, so that some belong to one."""
    heading = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in HEADED.items() for x in (k, v + "\n"))), F.col("lang")), F.lit(""))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit(1).alias("page"), F.concat(heading, "text").alias("text"))
    made = documents.chunks(documents.sections(pages), F.concat(F.lit("D"), F.col("file").cast("string")), F.lit(2025), 100, 500, 50)
    return made.select("file", "section", "piece_index", "chunk_index", "chunk_id", "category", F.length("text").alias("n_chars"))


@query("""
    with o as (select o_custkey as k, cast(year(o_orderdate) as integer) as y, cast(quarter(o_orderdate) as integer) as q, o_orderkey from orders),
    s as (select k, 'orders' as section, y, null as q, '{"n":' || count(*) || '}' as payload from o group by 1, 3 union all select k, 'orders', y, q, '{"n":' || count(*) || '}' from o group by 1, 3, 4
        union all select k, 'last', y, q, '{"order":' || max(o_orderkey) || '}' from o group by 1, 3, 4),
    r as (select *, dense_rank() over (partition by k, section, q is null order by y desc, q desc nulls last) as n from s where y >= 1994)
    select 'C' || k as symbol, section, y as year, cast(q as integer) as quarter, payload from r where n <= case when q is null then 2 else 3 end
""")
def company_market_data(spark, sf_dir):
    """Two sections of three that there are: a customer's latest two whole years and three quarters of each."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("symbol"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), "o_orderkey")
    whole = o.groupBy("symbol", "year").agg(F.count("*").alias("n")).withColumn("quarter", F.lit(0))
    sections = {
        "orders": o.groupBy("symbol", "year", "quarter").agg(F.count("*").alias("n")).unionByName(whole),
        "last": o.groupBy("symbol", "year", "quarter").agg(F.max("o_orderkey").alias("order")),
        "first": o.groupBy("symbol", "year", "quarter").agg(F.min("o_orderkey").alias("order")),
    }
    return company.market_data(sections, " orders, last", annual=2, quarterly=3, first=1994)
