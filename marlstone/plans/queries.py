"""One query for each operator over the standard tables, and the same in SQL.

The tables stand in for company data: customers or suppliers are symbols, order
years are report years, sums of prices are revenues.  Doubles are rounded on
both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import num, text
from marlstone.operators import docs as documents
from marlstone.operators import forecast, ingest, insights, market, panel, search, taxonomy, valuation, vectors
from marlstone.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(name: str, places: int = 4):
    return F.round(F.col(name), places).alias(name)


def company_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer and order year. Dealt by symbol before the sum, so that windows by symbol need no exchange of their own."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return orders.repartition("symbol").groupBy("symbol", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue_current"))


PANEL = "select cast(o_custkey as varchar) as symbol, cast(year(o_orderdate) as integer) as year, round(sum(o_totalprice), 2) as revenue_current from orders group by 1, 2"
W = "over (partition by symbol order by year)"


@query(f"""
    with p as ({PANEL}), l as (select *, lag(revenue_current) {W} as a, lag(revenue_current, 2) {W} as b from p)
    select symbol, year, revenue_current, a as revenue_lag1, b as revenue_lag2, round(case when coalesce(a, 0) <> 0 then (revenue_current / a - 1) * 100 else 0 end, 4) as revenue_yoy_pct,
        round(case when coalesce(a, 0) <> 0 then (revenue_current - a) / abs(a) * 100 else 0 end, 4) as revenue_momentum_pct, round(coalesce(revenue_current - a, 0), 4) as revenue_momentum_delta
    from l
""")
def panel_lag_features(spark, sf_dir):
    p = company_panel(spark, sf_dir)
    out = p.withColumns(panel.trend_features(p, "revenue_current", "revenue")).withColumn("revenue_momentum_delta", F.coalesce(F.col("revenue_current") - F.col("revenue_lag1"), F.lit(0.0)))
    return out.select("symbol", "year", "revenue_current", "revenue_lag1", "revenue_lag2", r("revenue_yoy_pct"), r("revenue_momentum_pct"), r("revenue_momentum_delta"))


@query(f"""
    with p as ({PANEL})
    select symbol, year, round(avg(revenue_current) over w, 4) as revenue_roll3_mean, round(coalesce(stddev_pop(revenue_current) over w, 0), 3) as revenue_roll3_std
    from p window w as (partition by symbol order by year rows between 2 preceding and current row)
""")
def panel_rolling_features(spark, sf_dir):
    p = company_panel(spark, sf_dir)
    out = p.withColumns(panel.trend_features(p, "revenue_current", "revenue"))
    return out.select("symbol", "year", r("revenue_roll3_mean"), r("revenue_roll3_std", 3))


LINE_PANEL = """select cast(l_suppkey as varchar) as symbol, cast(year(l_shipdate) as integer) as year, round(sum(l_extendedprice), 2) as revenue_current,
    round(sum(l_extendedprice * (0.25 - l_discount)), 4) as profit_after_tax, sum(l_quantity) as total_assets_reported from lineitem group by 1, 2"""


def supplier_panel(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.year("l_shipdate").alias("year"), "l_extendedprice", "l_discount", "l_quantity")
    sums = [F.round(F.sum("l_extendedprice"), 2).alias("revenue_current"), F.round(F.sum(F.col("l_extendedprice") * (0.25 - F.col("l_discount"))), 4).alias("profit_after_tax"), F.sum("l_quantity").alias("total_assets_reported")]
    return lines.groupBy("symbol", "year").agg(*sums)


@query(f"""
    with p as ({LINE_PANEL}), m as (select *, case when revenue_current <> 0 then profit_after_tax / revenue_current * 100 else 0 end as m from p)
    select symbol, year, round(m, 4) as profit_margin_calc_pct, round(coalesce(m - lag(m) {W}, 0), 4) as profit_margin_change from m
""")
def panel_margin_change(spark, sf_dir):
    return panel.delta_features(supplier_panel(spark, sf_dir)).select("symbol", "year", r("profit_margin_calc_pct"), r("profit_margin_change"))


@query(f"""
    with p as ({LINE_PANEL})
    select symbol, year, round(coalesce((total_assets_reported / nullif(lag(total_assets_reported) {W}, 0) - 1) * 100, 0), 4) as asset_growth_yoy from p
""")
def panel_growth_pct_change(spark, sf_dir):
    return panel.delta_features(supplier_panel(spark, sf_dir)).select("symbol", "year", r("asset_growth_yoy"))


MACRO = "select cast(year(o_orderdate) as integer) as year, round(avg(o_totalprice), 4) as price_mean from orders group by 1"


def macro_series(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("price_mean"))


@query(f"with p as ({PANEL}), m as ({MACRO}) select p.symbol, p.year, p.revenue_current, m.price_mean from p left join m on p.year = m.year + 1")
def macro_lagged_join(spark, sf_dir):
    return panel.with_macro(company_panel(spark, sf_dir), macro_series(spark, sf_dir), lag=1).select("symbol", "year", "revenue_current", "price_mean")


@query(f"""
    with p as ({PANEL}), m as (select * from ({MACRO}) where year not in (1995, 1997, 2000)), y as (select distinct year from p),
    f as (select y.year, coalesce((select max(m.year) from m where m.year <= y.year), (select min(m.year) from m)) as found from y)
    select p.symbol, p.year, m.price_mean from p join f on p.year = f.year left join m on m.year = f.found
""")
def macro_asof_lookup(spark, sf_dir):
    series = macro_series(spark, sf_dir).where("year not in (1995, 1997, 2000)").withColumn("ord", F.col("year"))
    return panel.macro_as_of(company_panel(spark, sf_dir), series, ["price_mean"], "ord").select("symbol", "year", "price_mean")


@query("""
    with b as (select cast(year(o_orderdate) as integer) as year, count(*) as orders_n, round(min(o_totalprice), 2) as price from orders group by 1),
    n as (select cast(year(o_orderdate) as integer) as year, round(max(o_totalprice), 2) as price, count(distinct o_custkey) as customers_n from orders group by 1)
    select b.year, b.orders_n, coalesce(n.price, b.price) as price, n.customers_n from b left join n on b.year = n.year and n.year >= 1998
""")
def macro_coalesce_merge(spark, sf_dir):
    by_year = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"))
    base = by_year.agg(F.count("*").alias("orders_n"), F.round(F.min("o_totalprice"), 2).alias("price"))
    new = by_year.agg(F.round(F.max("o_totalprice"), 2).alias("price"), F.countDistinct("o_custkey").alias("customers_n"))
    return panel.coalescing_merge(base, new, "year", from_key=1998)


SLUG = "coalesce(nullif(upper(regexp_replace(regexp_replace(%s, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'UNKNOWN')"


@query(f"""
    with i as (select 'C' || c_custkey as symbol, {SLUG % 'c_mktsegment'} as industry_group from customer where c_acctbal > 0)
    select o.o_orderkey, 'C' || o.o_custkey as symbol, coalesce(i.industry_group, 'UNKNOWN') as industry_group from orders o left join i on i.symbol = 'C' || o.o_custkey
""")
def industry_join_unknown(spark, sf_dir):
    industries = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), text.slug("c_mktsegment").alias("industry_group"), F.col("c_custkey").alias("ord"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("symbol"))
    return panel.with_industry(orders, industries, "ord").select("o_orderkey", "symbol", "industry_group")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("select c_custkey, " + ", ".join(f"case when c_mktsegment = '{s}' then 1.0::double else 0.0::double end as \"ind_{s}\"" for s in SEGMENTS) + " from customer")
def onehot_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return panel.one_hot(c, "c_mktsegment", SEGMENTS).drop("c_mktsegment")


@query(f"""
    with m as ({MACRO}), p as (select c_custkey, c_mktsegment, 1995 + c_custkey % 6 as year from customer)
    select p.c_custkey, case when c_mktsegment = 'BUILDING' then m.price_mean * 2 else 0 end as "ix_sector_BUILDING_price_mean",
        case when c_mktsegment = 'MACHINERY' then m.price_mean * 2 else 0 end as "ix_sector_MACHINERY_price_mean" from p left join m on p.year = m.year
""")
def sector_macro_interactions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (1995 + F.col("c_custkey") % 6).cast("int").alias("year"))
    joined = panel.with_macro(c, macro_series(spark, sf_dir))
    return panel.sector_interactions(joined, "c_mktsegment", {"BUILDING": ("price_mean",), "MACHINERY": ("price_mean",)}, boost=2.0).drop("c_mktsegment", "year", "price_mean")


@query("""
    with m as (select p_brand, avg(p_retailprice) as v from part where p_size < 40 group by 1)
    select p.p_partkey, round(coalesce(m.v, (select avg(v) from m)), 4) as brand_mean from part p left join m on p.p_brand = m.p_brand
""")
def target_encoding(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return panel.target_encoded(p, "p_brand", "p_retailprice", F.col("p_size") < 40, "brand_mean").select("p_partkey", r("brand_mean"))


@query("""
    with z as (select abs(quantile_cont(l_discount, 0.95)) <= 1.5 and abs(quantile_cont(l_discount, 0.05)) <= 1.5 as d, abs(quantile_cont(l_tax, 0.95)) <= 1.5 and abs(quantile_cont(l_tax, 0.05)) <= 1.5 as t,
        abs(quantile_cont(l_quantity, 0.95)) <= 1.5 and abs(quantile_cont(l_quantity, 0.05)) <= 1.5 as n from lineitem)
    select l_orderkey, l_linenumber, round(case when z.d then l_discount * 100 else l_discount end, 4) as l_discount, round(case when z.t then l_tax * 100 else l_tax end, 4) as l_tax,
        round(case when z.n then l_quantity * 100 else l_quantity end, 4) as l_quantity from lineitem, z
""")
def percent_like_scaling(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return panel.scaled_percent(lines, ("l_discount", "l_tax", "l_quantity")).select("l_orderkey", "l_linenumber", r("l_discount"), r("l_tax"), r("l_quantity"))


@query("""
    with b as (select quantile_cont(o_totalprice, 0.01) as lo, quantile_cont(o_totalprice, 0.99) as hi from orders where year(o_orderdate) <= 1999)
    select o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) as o_totalprice from orders, b
""")
def robust_clip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    bounds = panel.clip_bounds(o.where(F.year("o_orderdate") <= 1999), ["o_totalprice"])
    return panel.clipped(o, bounds).select("o_orderkey", r("o_totalprice"))


@query("""
    with b as (select quantile_cont(s_acctbal, 0.01) as lo, quantile_cont(s_acctbal, 0.99) as hi from supplier), c as (select *, least(greatest(s_acctbal, lo), hi) as d from supplier, b), t as (select quantile_cont(d, 0.8) as cut from c)
    select s_suppkey, case when d >= cut then 1.5::double else 1.0::double end as rate_multiplier, round((5 + s_suppkey % 7) * case when d >= cut then 1.5 else 1.0 end, 4)::double as rate from c, t
""")
def debt_rate_adjustment(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (5 + F.col("s_suppkey") % 7).cast("double").alias("rate"))
    params = panel.debt_parameters(s, F.col("s_acctbal"))
    return panel.debt_adjusted(s, "rate", F.col("s_acctbal"), params).select("s_suppkey", "rate_multiplier", r("rate"))


@query("""
    with g as (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal end as v from customer)
    select c_custkey, round(coalesce(v, (select median(v) from g)), 4) as v from g
""")
def median_impute(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("v"))
    return panel.median_imputed(c, ["v"]).select("c_custkey", r("v"))


@query("""
    select c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) as log_balance,
        round(sign(c_acctbal / nullif(100.0 * (c_custkey % 7), 0) - 1) * ln(1 + abs(c_acctbal / nullif(100.0 * (c_custkey % 7), 0) - 1)), 6) as growth from customer
""")
def log_transforms(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(num.log1p_nonneg("c_acctbal"), 6).alias("log_balance"), F.round(num.signed_log_growth(100.0 * (F.col("c_custkey") % 7), F.col("c_acctbal")), 6).alias("growth"))


@query("""
    with y as (select distinct cast(year(o_orderdate) as integer) as year from orders where year(o_orderdate) <= 1999), b as (select min(year) as a, max(year) as z from y)
    select year, round(0.35 + 0.65 * power(0.8, z - year), 6) as w_exp, round(0.35 + 0.65 * (year - a) / (z - a), 6) as w_linear, 1.0::double as w_none from y, b
""")
def recency_weights(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).where("year <= 1999").distinct()
    a, z = years.agg(F.min("year"), F.max("year")).first()
    return years.select("year", *(F.round(panel.recency_weight(F.col("year"), a, z, m), 6).alias(f"w_{m}") for m in ("exp", "linear", "none")))


@query("""
    with e as (select o_orderpriority, o_totalprice as y, o_totalprice * (0.9 + 0.01 * (o_orderkey % 20)) as p from orders)
    select o_orderpriority, count(*) as n, round(sum(abs(p - y)) / sum(abs(y)), 6) as wape, round(avg(abs((p - y) / nullif(y, 0))), 6) as mape, round(avg(abs(p - y)), 3) as mae,
        round(sqrt(avg((p - y) * (p - y))), 3) as rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) as r2 from e group by 1
""")
def error_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * (0.9 + 0.01 * (F.col("o_orderkey") % 20))).alias("p"))
    m = panel.error_metrics(o, "o_orderpriority", "y", "p")
    return m.select("o_orderpriority", "n", r("wape", 6), r("mape", 6), r("mae", 3), r("rmse", 3), r("r2", 6))


@query("""
    with d as (select event_type, cast(ts as date) as date, arg_max(value, event_id) as close, count(*)::double as volume from events group by 1, 2),
    b as (select *, close / nullif(lag(close) over (partition by event_type order by date), 0) - 1 as back from d)
    select event_type, cast(year(date) as integer) as year, round(avg(close), 4) as close_mean, arg_max(close, date) as close_last, round(avg(back) * 100, 4) as daily_return_mean_pct, round(avg(volume), 4) as volume_avg, sum(volume) as volume_sum,
        round(avg(close * volume), 4) as value_avg, round(sum(close * volume), 3) as value_sum, 'close_x_volume_proxy' as value_source, cast(null as double) as growth_yoy_pct from b group by 1, 2
""")
def yearly_market_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    daily = e.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))
    y = market.yearly(daily, ["event_type"])
    return y.select("event_type", "year", r("close_mean"), "close_last", r("daily_return_mean_pct"), r("volume_avg"), "volume_sum", r("value_avg"), r("value_sum", 3), "value_source", r("growth_yoy_pct"))


@query(f"with p as ({PANEL}), k as (select *, dense_rank() over (partition by symbol order by year desc) as n from p) select symbol, year, revenue_current from k where n <= 3")
def latest_n_years(spark, sf_dir):
    return panel.latest_years(company_panel(spark, sf_dir), ["symbol"], "year", 3)


@query("select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2")
def dedupe_keep_last(spark, sf_dir):
    return panel.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by 1, 2")
def dedupe_keep_first(spark, sf_dir):
    return panel.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_anti_join(spark, sf_dir):
    return ingest.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


HEX = "list_sum(list_transform(range(1, 17), lambda i: cast(instr('0123456789abcdef', substr(sha1(c_name), i::int, 1)) - 1 as hugeint) * cast(power(16::double, 16 - i) as hugeint)))"


@query(f"select c_custkey, cast({HEX} % 8 as integer) as shard from customer")
def hash_shard(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", num.sha1_shard("c_name", 8).alias("shard"))


@query("select sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def content_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]{2,}')"


@query(f"select doc_id, len({TOKENS}) as doc_len from documents")
def tokenize_counts(spark, sf_dir):
    return search.lengths(table(spark, sf_dir, "documents"), "doc_id", "text")


POSTINGS = f"select token, doc_id, count(*) as tf from (select doc_id, unnest({TOKENS}) as token from documents) group by 1, 2"


@query(f"with p as ({POSTINGS}), n as (select count(*) as n from documents) select token, count(*) as df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from p, n group by token, n")
def bm25_terms(spark, sf_dir):
    return search.terms(table(spark, sf_dir, "documents"), "doc_id", "text").select("token", "df", r("idf", 6))


@query(POSTINGS)
def bm25_postings(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
    with p as ({POSTINGS}), q as (select unnest(['the', 'tion', 'der', 'license']) as token), l as (select doc_id, len({TOKENS}) as len from documents), s as (select count(*) as n, avg(len) as av from l),
    d as (select token, count(*) as df from p group by 1)
    select p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))), 6) as score
    from p join q using (token) join d using (token) join l using (doc_id), s group by 1 order by 2 desc, 1 limit 20
""")
def bm25_topk(spark, sf_dir):
    found = search.bm25(table(spark, sf_dir, "documents"), ["the", "tion", "der", "license"], "doc_id", "text")
    return search.top(found.select("doc_id", r("score", 6)), 20, "doc_id")


def occurrences(word: str) -> str:
    return f"(length(lower(text)) - length(replace(lower(text), '{word}', ''))) / {len(word)}"


KEYWORD = f"{occurrences('license')} + {occurrences('the')} + {occurrences('and')} + 0.6 * {occurrences('tion')}"


@query(f"select doc_id, round({KEYWORD}, 4) as score from documents where {KEYWORD} > 0 order by 2 desc, 1 limit 20")
def keyword_score_topk(spark, sf_dir):
    return search.top(search.keyword(table(spark, sf_dir, "documents"), ["license", "the", "and", "tion"], "doc_id", "text").select("doc_id", r("score")), 20, "doc_id")


Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"


_ASKED = "select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0"


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    return vectors.VectorIndex.build(table(spark, sf_dir, "embeddings"), store.scratch(spark, "vector-index"))


@query(f"""
    with a as ({_ASKED}), s as (select query_id, vec_id as id, round(list_cosine_similarity(embedding::double[], q), 4) as score from a, embeddings where vec_id <> query_id)
    select query_id, cast(n as integer) as rank, score from (select *, row_number() over (partition by query_id order by score desc, id) as n from s) where n <= 10
""")
def vector_index_exact(spark, sf_dir):
    """All cells and full scores: what a plain scan finds."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return vector_index(spark, sf_dir).search(asked, 10, skip_own=True).select("query_id", "rank", r("score"))


@query(f"select query_id, cast(10 as bigint) as n_found, true as enough from ({_ASKED})")
def vector_index_search(spark, sf_dir):
    """As many cells as a sample of queries needs, codes first; enough: at least nine tenths of all queries' exact answers are found."""
    index, asked = vector_index(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    found = index.search(asked, 10, probes=index.probes_for(asked, skip_own=True), rescored=40, skip_own=True)
    enough = vectors.recall(found, index.search(asked, 10, skip_own=True)) >= 0.9
    return found.groupBy("query_id").agg(F.count("*").alias("n_found")).withColumn("enough", F.lit(enough))


def _vector(metric: str):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        q = e.where("vec_id = 0").select("embedding").first()[0]
        found = search.vector(e, q, metric, "vec_id", "embedding").select("vec_id", r("score", 6))
        return search.top(found, 10, "vec_id", search.METRICS[metric][1])

    run.__name__ = f"vector_topk_{metric}"
    return run


for _metric, _sql, _order in (
    ("cosine", "list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q)))", "desc"),
    ("dot", "list_dot_product(embedding::double[], q)", "desc"),
    ("euclid", "sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: power(embedding[i]::double - q[i], 2))))", "asc"),
    ("manhattan", "list_sum(list_transform(range(1, len(q) + 1), lambda i: abs(embedding[i]::double - q[i])))", "asc"),
):
    query(f"select vec_id, round({_sql}, 6) as score from embeddings, {Q} order by 2 {_order}, 1 limit 10")(_vector(_metric))


@query(f"""
    with v as (select vec_id as id, row_number() over (order by round(list_dot_product(embedding::double[], q), 6) desc, vec_id) as rank from embeddings, {Q} qualify rank <= 16),
    k as (select doc_id as id, row_number() over (order by round({KEYWORD}, 4) desc, doc_id) as rank from documents where {KEYWORD} > 0 qualify rank <= 16),
    u as (select id, rank, 0 as source from v union all select id, rank, 1 from k)
    select id, round(sum(1.0 / (60 + rank)), 6) as score from u group by 1
""")
def rrf_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    by_vector = search.top(search.vector(e, q, "dot", "vec_id", "embedding").select(F.col("vec_id").alias("id"), r("score", 6)), 16, "id")
    by_word = search.top(search.keyword(table(spark, sf_dir, "documents"), ["license", "the", "and", "tion"], "doc_id", "text").select(F.col("doc_id").alias("id"), r("score")), 16, "id")
    return search.fused([by_vector, by_word], 32, "id").select("id", r("score", 6))


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
    n as (select *, regexp_replace(strip_accents(lower(trim(line))), '\\s+', ' ', 'g') as n, regexp_replace(line, '[^A-Za-z]', '', 'g') as raw from l)
    select doc_id, count(*) as n_lines, count(*) filter (where length(n) between 1 and 160 and (regexp_matches(n, '^(chuong|phan|muc)\\b') or regexp_matches(n, '^\\d{1,2}(\\.\\d{1,2}){0,3}\\b') or regexp_matches(n, '^(i|ii|iii|iv|v|vi|vii|viii|ix|x)\\b')
        or (length(raw) between 4 and 80 and raw = upper(raw)) or (ends_with(trim(line), ':') and length(trim(line)) <= 120))) as n_headings from n group by 1
""")
def heading_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.is_heading("line")).alias("n_headings"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _normalized(x: str) -> str:
    return f"regexp_replace(lower({_strip(f'strip_accents({x})')}), '\\s+', ' ', 'g')"


def _noise(x: str) -> str:
    n = _normalized(x)
    return f"({n} = '' or {_strip(x)} in (':', '-', '--') or regexp_matches({n}, '^\\d{{1,3}}$') or regexp_matches({n}, '^\\d{{1,3}}\\s*/\\s*\\d{{1,3}}$') or (regexp_matches({n}, '^\\d+(\\.\\d+){{1,3}}$') and length({n}) <= 7))"


def _is_heading(x: str) -> str:
    n, raw = _normalized(x), f"regexp_replace({x}, '[^A-Za-z]', '', 'g')"
    return f"""(length({n}) between 1 and 160 and (regexp_matches({n}, '^(chuong|phan|muc)\\b') or regexp_matches({n}, '^\\d{{1,2}}(\\.\\d{{1,2}}){{0,3}}\\b') or regexp_matches({n}, '^(i|ii|iii|iv|v|vi|vii|viii|ix|x)\\b')
        or (length({raw}) between 4 and 80 and {raw} = upper({raw})) or (ends_with({_strip(x)}, ':') and length({_strip(x)}) <= 120)))"""


def _garbled(table: str, keep: str, text: str) -> str:
    """SQL of a query (keep, garbled, contents) over a table's text."""
    edge = """^[.,;:!?()\\[\\]{}"''`]+|[.,;:!?()\\[\\]{}"''`]+$"""
    return f"""
        select {keep}, n > 0 and (lost >= 0.01 * size or (lost >= 3 and lost >= 0.002 * size) or (odd >= 8 and odd >= 0.12 * n) or case
            when n >= 20 then odd >= 0.10 * n or (odd >= 0.07 * n and weird >= 0.03 * n) or (len(mixed) >= 0.40 * n and odd >= 5)
            when n >= 8 then odd >= 3 or (odd >= 0.20 * n and weird >= 1) else odd >= 2 or (weird >= 2 and lost >= 1) end) as garbled,
            len(lines) >= 6 and ((len(list_filter(lines, lambda x: length(x) <= 45)) >= 0.70 * len(lines) and len(list_filter(lines, lambda x: regexp_matches({_normalized('x')}, '^(\\d+|[ivx]+|[-•])'))) >= 0.45 * len(lines))
                or len(list_filter(lines, lambda x: regexp_matches(x, '\\.{{3,}}'))) >= 3) as contents
        from (select *, len(list_filter(mixed, lambda w: not (regexp_matches(w, '^[Qq][1-4](?:[/-]?\\d{{2,4}})?$') or regexp_matches(w, '^(?:FY|fy)\\d{{2,4}}$') or regexp_matches(w, '^[A-Z]{{2,8}}\\d{{2,4}}$') or regexp_matches(w, '^\\d+(?:[.,]\\d+)?[xX]$'))
                and (len(regexp_extract_all(w, '[A-Za-z]+|\\d+')) >= 3 or regexp_matches(w, '[A-Za-z]\\d[A-Za-z]') or regexp_matches(w, '\\d[A-Za-z]\\d')
                or (length(w) >= 6 and len(regexp_extract_all(w, '\\d')) >= 0.30 * (len(regexp_extract_all(w, '\\d')) + len(regexp_extract_all(w, '\\p{{L}}'))))))) as odd,
                len(list_filter(words, lambda w: regexp_matches(w, '[\\^~`|{{}}<>]'))) as weird, len(words) as n
            from (select *, list_filter(list_transform(words, lambda w: regexp_replace(w, '{edge}', '', 'g')), lambda w: regexp_matches(w, '[A-Za-z]') and regexp_matches(w, '\\d')) as mixed
                from (select *, regexp_extract_all({_strip(text)}, '\\S+') as words, length({_strip(text)}) as size, length({_strip(text)}) - length(replace({_strip(text)}, chr(65533), '')) as lost,
                    list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') as lines from {table})))
    """


def _pieces(text: str, least: int, most: int, overlap: int) -> str:
    """SQL of the list of a text's pieces before they get the end of the one before."""
    windows = f"list_transform(range(0, greatest(length(x.held) - {overlap}, 1), {most - overlap}), lambda k: {_strip(f'substr(x.held, cast(k as integer) + 1, {most})')})"
    flushed = "a.done || case when a.held <> '' then [a.held] else cast([] as varchar[]) end"
    parts = f"list_transform(list_filter(list_transform(regexp_split_to_array({text}, '\\n{{2,}}'), lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: {{'held': x, 'done': cast([] as varchar[])}})"
    step = f"""case when a.held <> '' and length(a.held) + 2 + length(x.held) <= {most} then {{'held': a.held || chr(10) || chr(10) || x.held, 'done': a.done}}
        when length(x.held) <= {most} then {{'held': x.held, 'done': {flushed}}} else {{'held': '', 'done': {flushed} || {windows}}} end"""
    packed = f"list_reduce([{{'held': '', 'done': cast([] as varchar[])}}] || {parts}, lambda a, x: {step})"
    return f"list_filter(list_transform([{packed}], lambda s: s.done || case when s.held <> '' then [s.held] else cast([] as varchar[]) end)[1], lambda p: length(p) >= {least})"


def _split(table: str, keep: str, text: str, least: int = 100, most: int = 500, overlap: int = 50) -> str:
    """SQL of (keep, piece_index, text) of a table's split texts."""
    tail = f"right(before, {overlap})"
    after = lambda pattern: f"nullif({_strip(f"regexp_extract({tail}, '(?s)^{pattern}\\s+(.*)$', 1)")}, '')"
    prefix = f"coalesce({after('.*[.!?;:]')}, {after('\\S*?')}, {_strip(tail)})"
    return f"""
        select {keep}, piece_index, case when piece_index = 0 or cut = '' then piece else cut || chr(10) || piece end as text from (
            select *, case when length(prefix) > room then case when room > 0 then regexp_replace(right(prefix, cast(room as bigint)), '^\\s+', '') else '' end else prefix end as cut from (
                select *, {prefix} as prefix, {most} - length(piece) - 1 as room from (
                    select {keep}, i - 1 as piece_index, pieces[i] as piece, coalesce(pieces[i - 1], '') as before from (
                        select *, unnest(range(1, len(pieces) + 1)) as i from (select {keep}, {_pieces(text, least, most, overlap)} as pieces from {table})))))
    """


def _category_case(s: str) -> str:
    has = lambda *w: f"regexp_matches({s}, '{'|'.join(w)}')"
    rules = [(f"regexp_matches({s}, '\\b1\\.7(\\.\\d+)?\\b')", "strategy"), (f"regexp_matches({s}, '\\b1\\.8(\\.\\d+)?\\b')", "risk"), (f"regexp_matches({s}, '\\b1\\.10(\\.\\d+)?\\b') and {has('rui ro')}", "risk")]
    rules += [(f"{has('chuong 3')} and {has('ban dieu hanh', 'danh gia')}", "mdna"), (f"{has('chuong 5', 'phan 4')} and {has('quan tri')}", "governance"), (f"{has('chuong 6', 'phan 6')} and {has('ben vung', 'esg')}", "sustainability")]
    rules += [(f"{has('chuong 1', 'phan 1')} and {has('ve chung toi', 'tong quan', 'thong tin chung')}", "business_overview"), (has("bao cao ban giam doc", "ban dieu hanh", "danh gia ket qua hoat dong"), "mdna")]
    rules += [(has(*words), name) for name, words in text.CATEGORIES.items()]
    return "case " + " ".join(f"when {rule} then '{name}'" for rule, name in rules) + " else 'other' end"


def _section_chunks_sql(pages: str = "documents", focus: bool = False) -> str:
    s = f"trim({_normalized('heading')} || ' ' || {_normalized('preview')})"
    found = _normalized("heading || ' ' || text")
    wanted = f"(select * from c where category in {documents.FOCUS})" if focus else "c"
    return f"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no from {pages}), t as (select doc_id, line_no, {_strip('raw')} as line from l),
        h as (select *, {_is_heading('line')} as heading from t where line <> ''), m as (select *, count(*) filter (where heading) over (partition by doc_id order by line_no) as section from h),
        e as (select doc_id as file, section, coalesce(max(case when heading then line end), '{documents.FIRST_HEADING}') as heading, string_agg(line, chr(10) order by line_no) as text from m group by 1, 2),
        p as (select *, array_to_string(list_transform(string_split(text, chr(10))[1:3], lambda x: {_strip('x')}), ' ') as preview from e where length(text) >= 100),
        c as (select *, {_category_case(s)} as category from p where not {_noise('heading')} and not regexp_matches({found}, '{"|".join(documents.DISCLOSURES)}')),
        k as ({_split(wanted, 'file, section, category', 'text')}), g as ({_garbled('k', 'file, section, category, piece_index, text', 'text')}),
        n as (select *, row_number() over (partition by file order by section, piece_index) as chunk_index from g where not garbled and not contents)
        select file, section, cast(piece_index as integer) as piece_index, cast(chunk_index as integer) as chunk_index, 'D' || file || '_2025_' || lpad(cast(chunk_index as varchar), 4, '0') as chunk_id, category, length(text) as n_chars from n
    """


@query(f"""
    with g as ({_garbled('documents', 'doc_id, text', 'text')})
    select doc_id, garbled, contents, {_noise('string_split(text, chr(10))[1]')} as noise, len(list_filter(string_split(text, chr(10)), lambda y: {_noise('y')})) as n_noise from g
""")
def text_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    noise = (text.is_noise_heading(lines[0]).alias("noise"), F.size(F.filter(lines, lambda x: text.is_noise_heading(x))).alias("n_noise"))
    return d.select("doc_id", text.is_garbled("text").alias("garbled"), text.looks_like_contents("text").alias("contents"), *noise)


@query(_section_chunks_sql())
def section_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit(1).alias("page"), "text")
    made = documents.chunks(documents.sections(pages), F.concat(F.lit("D"), F.col("file").cast("string")), F.lit(2025), 100, 500, 50, focus=False)
    return made.select("file", "section", "piece_index", "chunk_index", "chunk_id", "category", F.length("text").alias("n_chars"))


@query(f"select doc_id, cast(piece_index as integer) as piece_index, length(text) as n_chars, md5(text) as digest from ({_split('documents', 'doc_id', 'text')})")
def split_overlap(spark, sf_dir):
    pieces = documents.split_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 100, 500, 50)
    return pieces.select("doc_id", "piece_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _category_sql() -> str:
    cases = " ".join(f"when regexp_matches(s, '{'|'.join(words)}') then '{name}'" for name, words in text.CATEGORIES.items())
    return f"""
        with d as (select doc_id, trim(regexp_replace(strip_accents(lower(array_to_string(list_transform(string_split(text, chr(10))[1:3], lambda x: trim(x)), ' '))), '\\s+', ' ', 'g')) as s from documents)
        select doc_id, case when regexp_matches(s, '\\b1\\.7(\\.\\d+)?\\b') then 'strategy' when regexp_matches(s, '\\b1\\.8(\\.\\d+)?\\b') then 'risk' when regexp_matches(s, 'ban dieu hanh|danh gia ket qua hoat dong') then 'mdna' {cases} else 'other' end as category from d
    """


@query(_category_sql())
def category_classify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.category(F.lit(""), F.col("text")).alias("category"))


@query("""
    with h as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as host, regexp_extract_all(html, '<a href="([^"]+)"', 1) as l from pages), u as (select page_id, host || unnest(l) as link, generate_subscripts(l, 1) as pos from h),
    f as (select page_id, regexp_replace(link, '#.*$', '') as link, min(pos) as pos from u where regexp_matches(link, 'a') group by 1, 2)
    select page_id, cast(row_number() over (partition by page_id order by pos) as integer) as link_no, link from f
""")
def page_links(spark, sf_dir):
    return documents.links(table(spark, sf_dir, "pages"), wanted="a")


@query(f"""
    with l as (select page_id, list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') as l from pages), d as (select page_id, l, list_transform(l, lambda x: regexp_replace(x, '\\.+$', '')) as d from l),
    j as (select page_id, len(l) as n_lines, array_to_string(list_filter(d, lambda x, i: list_position(list_transform(d, lambda y: lower(y)), lower(x)) = i), '; ') as j from d)
    select page_id, n_lines, md5(case when length(j) > 2000 then rtrim(substr(j, 1, 1999)) || '…' else j end) as digest from j
""")
def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(documents.html_lines(F.col("html"))).alias("n_lines"), F.md5(documents.business_areas(F.col("html"))).alias("digest"))


def valuation_inputs(spark, sf_dir):
    """Made-up figures of each customer, derived from its key so that every branch occurs."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("symbol"), (F.col("c_acctbal") / 2).alias("eps"), (1000.0 + k % 900 * 10).alias("bvps"), ((k % 40) / 100 - 0.05).alias("roe"), F.when(k % 17 != 0, 1000.0 + k % 500 * 20).alias("live_price"),
        F.when(k % 5 != 0, (k % 30) / 100).alias("cagr"), F.when(k % 4 != 0, 5.0 + k % 20).alias("median_pe"), F.when(k % 6 != 0, 0.5 + (k % 8) / 4).alias("median_pb"), F.when(k % 3 == 0, 100.0 + k % 50).alias("forecast_profit"), F.when(k % 9 != 0, 1e8 + k).alias("cplh"),
        valuation.industry(F.when(k % 2 == 0, F.element_at(F.array(*map(F.lit, _CODES)), (k % len(_CODES) + 1).cast("int"))), F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))).alias("industry"),
    )


_CODES = ("8355", "8777", "3521", "5379", "9599", "1799", "3571", "6501", "2779", "4530", "0001", "")
_NAMES = ("Ngân hàng", "Chứng khoán ABC", "bán lẻ", "Công nghệ thông tin", "Thép", "Điện", "Khác", "Y tế")


def _industry_sql(code: str, label: str) -> str:
    exact = " ".join(f"when {code} = '{k}' then '{v}'" for k, v in valuation.ICB)
    prefix = " ".join(f"when {code} <> '' and starts_with('{k}', substr({code}, 1, {n})) then '{v}'" for n in (3, 2) for k, v in valuation.ICB)
    names = " ".join(f"when lower({label}) = '{k}' then '{v}'" for k, v in valuation.LABELS) + " " + " ".join(f"when contains(lower({label}), '{k}') then '{v}'" for k, v in valuation.LABELS)
    return f"case {exact} {prefix} {names} else 'DEFAULT' end"


_INPUTS = f"""
    select cast(c_custkey as varchar) as symbol, c_acctbal / 2 as eps, 1000.0 + c_custkey % 900 * 10 as bvps, (c_custkey % 40) / 100 - 0.05 as roe, case when c_custkey % 17 <> 0 then 1000.0 + c_custkey % 500 * 20 end as live_price,
        case when c_custkey % 5 <> 0 then (c_custkey % 30) / 100 end as cagr, case when c_custkey % 4 <> 0 then 5.0 + c_custkey % 20 end as median_pe, case when c_custkey % 6 <> 0 then 0.5 + (c_custkey % 8) / 4 end as median_pb,
        case when c_custkey % 3 = 0 then 100.0 + c_custkey % 50 end as forecast_profit, case when c_custkey % 9 <> 0 then 1e8 + c_custkey end as cplh,
        case when c_custkey % 2 = 0 then {list(_CODES)!r}[c_custkey % {len(_CODES)} + 1] end as code, {list(_NAMES)!r}[c_custkey % {len(_NAMES)} + 1] as label from customer
"""


@query(f"with i as ({_INPUTS}) select symbol, {_industry_sql('code', 'label')} as industry from i")
def resolve_industry(spark, sf_dir):
    return valuation_inputs(spark, sf_dir).select("symbol", "industry")


_PLAYBOOK = " union all ".join(f"select '{k}' as industry, {a}::double as w_pe, {b}::double as w_pb, {c}::double as w_ps, {d}::double as coe, {e}::double as dg" for k, (a, b, c, d, e) in valuation.PLAYBOOK.items())


@query(f"""
    with i as ({_INPUTS}), j as (select symbol, eps::double as eps, bvps::double as bvps, roe::double as roe, live_price::double as live_price, cagr::double as cagr, median_pe::double as median_pe, median_pb::double as median_pb, forecast_profit::double as forecast_profit, cplh::double as cplh,
        {_industry_sql('code', 'label')} as industry from i), p as ({_PLAYBOOK}),
    a as (select *, greatest(case when cagr is null then dg else least(cagr, coe - greatest(0.03, 0.25 * coe)) end, 0) as g, case when coalesce(forecast_profit, 0) <> 0 and coalesce(cplh, 0) > 0 then forecast_profit * 1e9 / cplh else eps end as feps from j join p using (industry)),
    b as (select *, (roe - g) / nullif(coe - g, 0) as rpb, (roe - g) / nullif(coe - g, 0) / nullif(roe, 0) as rpe from a),
    c as (select *, case when rpe / median_pe > 2 then 1.5 * median_pe when rpe / median_pe < 0.5 then 0.7 * median_pe end as lim from b),
    d as (select *, case when roe <= 0 or coe <= g then coalesce(median_pe, 15) else coalesce(lim, rpe) end as pe, case when roe <= 0 or coe <= g then coalesce(median_pb, 2) else coalesce(lim * roe, rpb) end as pb,
        case when w_ps > 0 and w_pb > 0 then w_pe + w_ps / 2 else w_pe end as u_pe, case when w_ps > 0 and w_pb = 0 then w_ps when w_ps > 0 then w_pb + w_ps / 2 else w_pb end as u_pb from c),
    e as (select *, case when feps > 0 then feps * pe else 0 end as price_pe, case when bvps > 0 then bvps * pb else 0 end as price_pb from d),
    f as (select *, round_even((price_pe * u_pe + price_pb * u_pb) / (u_pe + u_pb) / 100, 0) * 100 as fair_price from e),
    h as (select *, case when live_price > 0 then (fair_price - live_price) / live_price * 100 else 0 end as up from f)
    select symbol, industry, round(g, 6) as growth, round(pe, 4) as target_pe, round(pb, 4) as target_pb, fair_price, round(up, 4) as upside_pct, case when up > 15 then 'UNDERVALUED' when up < -15 then 'OVERVALUED' else 'FAIR' end as verdict from h
""")
def fair_value(spark, sf_dir):
    v = valuation.fair_values(valuation_inputs(spark, sf_dir))
    return v.select("symbol", "industry", r("growth", 6), r("target_pe"), r("target_pb"), "fair_price", r("upside_pct"), "verdict")


@query(f"""
    with p as ({LINE_PANEL}), s as (select symbol, year, profit_after_tax - 20000 as profit from p), x as (select symbol, arg_min(profit, year) as a, arg_max(profit, year) as b, max(year) - min(year) as n from s where profit > 0 group by 1),
    c as (select symbol, case when n > 0 then power(b / a, 1.0 / n) - 1 end as v from x)
    select distinct s.symbol, round(case when v between -0.5 and 1.0 then v end, 6) as cagr from s left join c on s.symbol = c.symbol
""")
def profit_cagr(spark, sf_dir):
    profits = supplier_panel(spark, sf_dir).select("symbol", "year", (F.col("profit_after_tax") - 20000).alias("profit"))
    return valuation.profit_cagr(profits).select("symbol", r("cagr", 6))


@query("""
    with d as (select p_type, p_retailprice / 100 as pe, case when p_size % 3 = 0 then (p_size / 10.0)::double end as pb, (p_size * 1.0)::double as ps from part)
    select p_type, round(avg(pe), 4) as pe_mean, round(median(pe), 4) as pe_median, round(avg(pb), 4) as pb_mean, round(median(pb), 4) as pb_median, round(avg(ps), 4) as ps_mean, round(median(ps), 4) as ps_median, count(pe) as data_points_count from d group by 1
""")
def valuation_summary(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_type", (F.col("p_retailprice") / 100).alias("pe"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 10.0).alias("pb"), (F.col("p_size") * 1.0).alias("ps"))
    s = valuation.multiple_summary(d, "p_type")
    return s.select("p_type", *(r(f"{c}_{n}") for c in ("pe", "pb", "ps") for n in ("mean", "median")), "data_points_count")


_PART = """with m as (select p_type, avg(p_retailprice) as me, median(p_retailprice) as md from part group by 1), j as (select p_partkey, p_retailprice as v, me, md from part join m using (p_type))"""


def part_prices(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.join(p.groupBy("p_type").agg(F.avg("p_retailprice").alias("me"), F.median("p_retailprice").alias("md")), "p_type")


@query(f"""{_PART} select p_partkey, case when d <= -0.15 then 'rẻ tương đối' when d <= -0.05 then 'hơi rẻ' when d >= 0.15 then 'đắt tương đối' when d >= 0.05 then 'hơi đắt' else 'gần trung vị lịch sử' end as view from (select *, (v - md) / abs(md) as d from j)""")
def relative_view(spark, sf_dir):
    return part_prices(spark, sf_dir).select("p_partkey", num.relative_view("p_retailprice", "md").alias("view"))


@query(f"""
    {_PART}, k as (select *, (v - me) / me * 100 as a, (v - md) / md * 100 as b from j)
    select p_partkey, round(a, 4) as diff_vs_mean_pct, round(b, 4) as diff_vs_median_pct, case when a > 3 then 'OVERVALUED' when a < -3 then 'UNDERVALUED' else 'FAIR' end as status_vs_mean,
        case when b > 3 then 'OVERVALUED' when b < -3 then 'UNDERVALUED' else 'FAIR' end as status_vs_median from k
""")
def metric_status(spark, sf_dir):
    s = valuation.metric_status(part_prices(spark, sf_dir), "p_retailprice", "me", "md")
    return s.select("p_partkey", r("diff_vs_mean_pct"), r("diff_vs_median_pct"), "status_vs_mean", "status_vs_median")


_NODES = """
    select lpad(cast(r_regionkey + 1 as varchar), 1, '0') || '000' as code, 1 as level from region union
    select cast(n_regionkey + 1 as varchar) || cast(n_nationkey % 10 as varchar) || '00', 2 from nation where n_nationkey % 4 <> 0 union
    select cast(n_regionkey + 1 as varchar) || cast(n_nationkey % 10 as varchar) || '50', 3 from nation union
    select cast(n_regionkey + 1 as varchar) || cast(n_nationkey % 10 as varchar) || '55', 4 from nation
"""


def nodes(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    stem = F.concat((F.col("n_regionkey") + 1).cast("string"), (F.col("n_nationkey") % 10).cast("string"))
    out = region.select(F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit("000")).alias("code"), F.lit(1).alias("level"))
    for end, level, rows in (("00", 2, nation.where("n_nationkey % 4 <> 0")), ("50", 3, nation), ("55", 4, nation)):
        out = out.unionByName(rows.select(F.concat(stem, F.lit(end)).alias("code"), F.lit(level).alias("level")))
    return out.distinct()


@query(f"""
    with n as ({_NODES}), p as (select code, level, case level when 2 then substr(code, 1, 1) || '000' when 3 then substr(code, 1, 2) || '00' when 4 then substr(code, 1, 3) || '0' end as parent from n)
    select code, level, case when parent in (select code from n) then parent end as parent_code from p
""")
def taxonomy_parents(spark, sf_dir):
    return taxonomy.with_parents(nodes(spark, sf_dir)).select("code", "level", "parent_code")


@query(f"""
    with n as (select rtrim(code, '0') as code, level from ({_NODES})), u as (select distinct code, level from n)
    select a.code, a.level, (select b.code from u b where b.level < a.level and length(b.code) < length(a.code) and starts_with(a.code, b.code) order by length(b.code) desc limit 1) as parent_code from u a
""")
def longest_prefix_parent(spark, sf_dir):
    short = nodes(spark, sf_dir).select(F.regexp_replace("code", "0+$", "").alias("code"), "level").distinct()
    return taxonomy.longest_prefix_parents(short).select("code", "level", "parent_code")


@query("""
    select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_totalprice end, case when o_orderkey % 2 = 0 then 1.0 end) as total, case when o_orderkey % 5 = 0 then 1 else 0 end::bigint as n_warnings from orders
""")
def alias_coalesce(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, F.col("o_totalprice")).alias("a"), F.when(k % 2 == 0, F.lit("1.0")).alias("b"), F.when(k % 5 == 0, F.lit("x")).alias("bad"))
    made = ingest.statement_rows(rows.withColumn("year", F.lit(2024)), F.col("o_orderkey"), {"total": ("missing", "a", "b"), "other": ("bad",)})
    return made.select(F.col("companyId").alias("o_orderkey"), "total", F.size("_warnings").cast("long").alias("n_warnings"))


@query("select c_custkey, cast(c_custkey as varchar) as a, case when c_custkey % 2 = 0 then 'X' || c_custkey end as b from customer")
def icb_normalize(spark, sf_dir):
    k = F.col("c_custkey")
    loose = F.concat(F.lit(" "), k.cast("string"), F.lit(".0 "))
    return table(spark, sf_dir, "customer").select("c_custkey", ingest.icb_code(loose).alias("a"), ingest.icb_code(F.when(k % 2 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.lit(" "))).alias("b"))


@query("""
    select event_id, case when event_type = 'purchase' then 'CASH' else 'STOCK' end as "eventType" from events where event_type in ('purchase', 'view')
""")
def dividend_events(spark, sf_dir):
    title = F.when(F.col("event_type") == "purchase", "Trả cổ tức bằng tiền mặt").when(F.col("event_type") == "view", "Thưởng cổ phiếu").when(F.col("event_type") == "click", "Họp đại hội")
    rows = table(spark, sf_dir, "events").select("event_id", title.alias("event_title"), F.lit(None).cast("string").alias("event_list_name"))
    return ingest.dividend_events(rows).select("event_id", "eventType")


@query("""
    with i as (select conv_id, turn as place, case when turn % 3 = 0 then 'warning' when turn % 3 = 1 then 'TIP' else 'note' end as type, trim(text) as title, trim(text) as message, turn / 4.0 as c from conversations where turn < 5),
    g as (select conv_id, upper(type) as type, place, trim(substr(title, 1, 60)) as title, substr(message, 1, 180) as message, least(greatest(c, 0), 1) as confidence from i where upper(type) in ('WARNING', 'TIP') and title <> '' and message <> ''),
    l as (select conv_id, type, max(place) as place from g group by 1, 2), k as (select distinct conv_id, unnest(['WARNING', 'TIP']) as type from conversations)
    select k.conv_id, k.type, case when g.place is not null then 'insight-' || g.place when k.type = 'WARNING' then 'fallback-warning' else 'fallback-tip' end as id, round(coalesce(g.confidence, 0.7), 4)::double as confidence
    from k left join l using (conv_id, type) left join g on g.conv_id = l.conv_id and g.type = l.type and g.place = l.place
""")
def insight_normalise(spark, sf_dir):
    turn = F.col("turn")
    items = table(spark, sf_dir, "conversations").select("conv_id", turn.alias("place"), F.lit(None).cast("string").alias("id"), F.when(turn % 3 == 0, "warning").when(turn % 3 == 1, "TIP").otherwise("note").alias("type"), F.trim("text").alias("title"), F.trim("text").alias("message"), (turn / 4.0).alias("confidence"))
    return insights.insights(items, "conv_id").select("conv_id", "type", "id", r("confidence"))


@query("""
    select event_id, case when value - 50 > 0 then value - 50 end as amount, case when user_id % 10 in (1, 2, 3) then cast(user_id % 10 as varchar) end as "categoryId", round(least(greatest(value / 100, 0), 1), 4) as confidence,
        array_to_string(list_filter([case when value - 50 > 0 then null else 'amount' end, case when event_type = 'error' then 'type' end, case when user_id % 10 in (1, 2, 3) then null else 'categoryId' end, 'accountId'], lambda x: x is not null), ',') as missing from events
""")
def prefill_validate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    drafts = e.select("event_id", (F.col("value") - 50).alias("amount"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("type"), (F.col("user_id") % 10).cast("string").alias("categoryId"), F.lit(None).cast("string").alias("accountId"), F.lit("n").alias("note"), F.col("ts").cast("string").alias("transactionDate"), (F.col("value") / 100).alias("confidence"), F.array().cast("array<string>").alias("warnings"))
    done = insights.prefill(drafts, F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.array(F.lit("a")))
    return done.select("event_id", "amount", "categoryId", r("confidence"), F.array_join("missingFields", ",").alias("missing"))


@query("select event_id, replace(props, ' ', '') as fixed from events")
def json_repair(spark, sf_dir):
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events")
    broken = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.regexp_replace("props", "\\}$", ",}")).otherwise(F.regexp_replace("props", "^\\{|\\}$", ""))
    return e.select("event_id", F.replace(insights.repaired_json(broken), F.lit(" "), F.lit("")).alias("fixed"))


@query("""
    with m as (select o_custkey, date_trunc('month', o_orderdate) as month, round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end), 2) as income, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as expense from orders group by 1, 2),
    k as (select *, row_number() over (partition by o_custkey order by month desc) as n, count(*) over (partition by o_custkey) as many from m)
    select o_custkey, bool_or(n <= 2 and many >= 2 and (income > 0 or expense > 0)) as active, cast(round_even(sum(expense) / nullif(sum(income), 0) * 100, 0) as integer) as spending_pct from k group by 1
""")
def monthly_activity_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda s, n: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0)), 2).alias(n)
    monthly = o.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("month")).agg(part("O", "income"), part("F", "expense"))
    series = monthly.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("month", "income", "expense"))).alias("series"), F.sum("income").alias("i"), F.sum("expense").alias("e"))
    return series.select("o_custkey", insights.recently_active(F.col("series")).alias("active"), insights.spending_percent(F.col("e"), F.col("i")).alias("spending_pct"))


_DRIVERS = "select cast(l_suppkey as varchar) as symbol, 'revenue' as target, cast(year(l_shipdate) as integer) as year, l_returnflag || l_linestatus as feature, round(sum(l_extendedprice * (l_discount - 0.05)), 4) as score from lineitem group by 1, 3, 4"


@query(f"""
    with d as ({_DRIVERS}), s as (select *, abs(score) / nullif(sum(abs(score)) over (partition by symbol, year), 0) * 100 as sh, row_number() over (partition by symbol, year order by abs(score) desc, feature) as rank from d)
    select s.symbol, s.year, s.feature, round(s.sh, 6) as share_pct, round(s.sh - b.sh, 6) as delta_pct, case when s.score > 0 then 'POSITIVE' when s.score < 0 then 'NEGATIVE' else 'NEUTRAL' end as direction, cast(s.rank as integer) as rank
    from s left join s b on b.symbol = s.symbol and b.feature = s.feature and b.year = s.year - 1 where s.rank <= 3
""")
def driver_shares(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    d = lines.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.lit("revenue").alias("target"), F.year("l_shipdate").alias("year"), F.concat("l_returnflag", "l_linestatus").alias("feature")).agg(F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), 4).alias("score"))
    return forecast.driver_shares(d, 3).select("symbol", "year", "feature", r("share_pct", 6), r("delta_pct", 6), "direction", "rank")


@query(f"""
    with recursive p as ({PANEL}), b as (select symbol, arg_max(revenue_current, year) as r, arg_max(revenue_current, year) * 0.1 as f from p group by 1),
    w(symbol, year, revenue, profit, n) as (select symbol, 2001, r, f, 0 from b union all select symbol, year + 1, revenue * 1.05, profit + 1000, n + 1 from w where n < 3)
    select symbol, cast(year as integer) as year, revenue, profit as profit_after_tax, case when n = 0 then 'base' else 'predicted' end as source from w
""")
def recursive_forecast(spark, sf_dir):
    latest = company_panel(spark, sf_dir).groupBy("symbol").agg(F.max_by("revenue_current", "year").alias("revenue_current")).withColumn("profit_after_tax", F.col("revenue_current") * 0.1)
    empty = {f"{n}_lag{k}": F.lit(None).cast("double") for n in ("revenue", "profit") for k in (1, 2)}
    grow = lambda s, year: s.withColumns({"revenue_next": F.col("revenue_current") * 1.05, "profit_next": F.col("profit_after_tax") + 1000})
    return forecast.recursive(latest.withColumns(empty), grow, 2001, 2004)


@query("""
    with n as (select o_custkey as k, arg_max(o_totalprice, o_orderkey) as v, 'new' as source from orders where o_orderstatus = 'F' group by 1), o as (select o_custkey as k, arg_max(o_totalprice, o_orderkey) as v, 'old' as source from orders where o_orderstatus <> 'F' group by 1)
    select * from n union all select * from o where k not in (select k from n)
""")
def merge_shards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("late"))
    shard = lambda late, name: panel.keep_last(o.where(F.col("late") == late).withColumn("source", F.lit(name)).drop("late"), ["k"], "o_orderkey").drop("o_orderkey")
    return store.merged([shard(False, "old"), shard(True, "new")], ["k"])


@query("""
    with h as (select vec_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(cast(vec_id as varchar))) as h from embeddings)
    select vec_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from h
""")
def vector_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    store.checked_vectors(e)
    return store.points(e.select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"))).select("vec_id", "point_id")


@query("""
    with k as (select 'S' || l_partkey as symbol, cast(year(l_shipdate) as integer) as target_year, l_returnflag = 'N' as revenue, l_extendedprice as v, l_orderkey * 10 + l_linenumber as ord from lineitem)
    select symbol, target_year, arg_max(v, ord) filter (where revenue) as revenue_pred, arg_max(v, ord) filter (where not revenue) as profit_pred from k group by 1, 2
""")
def wide_predictions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    detail = lines.select(
        F.concat(F.lit(" s"), "l_partkey").alias("symbol"), F.year("l_shipdate").alias("target_year"), F.when(F.col("l_returnflag") == "N", "revenue_next").otherwise("Profit_next").alias("target"), F.col("l_extendedprice").alias("predicted"),
        F.lit(None).cast("double").alias("actual"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return forecast.wide_predictions(detail, "ord").select("symbol", "target_year", "revenue_pred", "profit_pred")


@query("""
    select event_type, date_trunc('day', ts) as window_start, count(*) as n, round(sum(value), 3) as total from events group by 1, 2
""")
def event_rollup(spark, sf_dir):
    from marlstone.streaming import ingest as incremental

    return incremental.rollup(table(spark, sf_dir, "events"), "ts", "value", ["event_type"]).select("event_type", "window_start", "n", r("total", 3))
