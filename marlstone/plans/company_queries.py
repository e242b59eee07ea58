"""Queries of company records, replies and names over the standard tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import boosting, company, explain, forecast, insights, panel
from marlstone.plans.queries import LINE_PANEL, PANEL, W, company_panel, macro_series, query, r, supplier_panel, table

_SPACE = "regexp_replace(%s, '^\\s+|\\s+$', '', 'g')"


@query("""
    with v as (select c_custkey as k, c_mktsegment as s, c_nationkey as n, c_name from customer)
    select k as c_custkey, case when k % 5 <> 0 then c_name when k % 10 = 0 then 'Inner ' || k else 'Organ ' || k end as "companyName",
        case when k % 4 = 0 then 'L2 > L3' when k % 3 = 0 then 'L2' else s end as "industryLabelFull",
        case when k % 7 <> 0 then cast(n as varchar) else '35' || (k % 10) end as "icbCode",
        case when k % 5 <> 0 then c_name when k % 10 = 0 then 'Inner ' || k else 'Organ ' || k end || ' hoạt động trong lĩnh vực ' || case when k % 2 = 0 then s else 'L2' end
            || case when k % 6 = 0 then ' thành lập năm 1999' else '' end || case when k % 8 = 0 then ' Website: w.vn' else '' end as description
    from (select k, case when k % 2 = 1 and k % 4 <> 0 and k % 3 <> 0 then 'L2' else s end as s, n, c_name from v)
""")
def vendor_overview(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 5 != 0, F.col("c_name")).otherwise(" ").alias("Short_Name"), F.when(k % 10 == 5, F.concat(F.lit("Organ "), k.cast("string"))).alias("organ_name"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).alias("industry"), F.when((k % 4 == 0) | (k % 3 == 0) | (k % 2 == 1), " L2 ").alias("icb_name2"), F.when(k % 4 == 0, "L3").alias("icb_name3"), F.when(k % 4 == 0, "L2").alias("icb_name4"),
        F.when(k % 7 != 0, F.col("c_nationkey").cast("double")).alias("icb_code"), F.concat(F.lit("35"), (k % 10).cast("string")).alias("icbCode3"), F.when(k % 6 == 0, "1999").alias("established_year"), F.when(k % 8 == 0, "w.vn").alias("website"),
        F.format_string('{"a": {"x": [{"companyName": "Inner %d"}]}, "fullName": null}', k).alias("company_profile"),
    )
    return company.overview(rows).select("c_custkey", "companyName", "industryLabelFull", "icbCode", "description")


@query(f"""
    with p as ({LINE_PANEL})
    select symbol as "companyId", year, 1 as quarter, cast(null as double) as "netInterestIncome", revenue_current as "interestExpense", profit_after_tax as "netProfit" from p
""")
def pushed_income(spark, sf_dir):
    rows = supplier_panel(spark, sf_dir).withColumnsRenamed({"revenue_current": "interestAndSimilarExpenses", "profit_after_tax": "netProfit"})
    return company.pushed(rows, "income", True, F.col("symbol")).select("companyId", "year", "quarter", "netInterestIncome", "interestExpense", "netProfit")


_VIEW = "case when d <= -0.15 then 'rẻ tương đối' when d <= -0.05 then 'hơi rẻ' when d >= 0.15 then 'đắt tương đối' when d >= 0.05 then 'hơi đắt' when d is not null then 'gần trung vị lịch sử' end"


@query(f"""
    with s as (select 'S' || s_suppkey as symbol, round(s_acctbal, 2) as v, s_nationkey as n from supplier), t as (select *, (v - n * 100) / nullif(abs(n * 100.0), 0) as d from s)
    select symbol, 'x' as "livePriceSource", v as "livePe", n * 100.0::double as "medianPe", {_VIEW} as "peView", cast(null as varchar) as "pbView" from t
""")
def live_snapshot(spark, sf_dir):
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.lit("x").alias("livePriceSource"), F.round("s_acctbal", 2).alias("livePe"), (F.col("s_nationkey") * 100).alias("medianPE"), F.lit("none").alias("livePb")).alias("overview"), F.lit(1).alias("other")))
    rows = table(spark, sf_dir, "supplier").select(payload.alias("payload"), F.lit("").alias("symbol"))
    return company.live_snapshot(rows).select("symbol", "livePriceSource", "livePe", "medianPe", "peView", "pbView")


@query("select s_suppkey, '{\"symbol\":\"s' || s_suppkey || '\"}' as overview from supplier")
def company_metrics(spark, sf_dir):
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("s"), "s_suppkey").alias("symbol")).alias("overview"), F.array(F.lit(1)).alias("annual")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", company.company_overview(payload).alias("overview"))


@query("""
    with l as (select upper(c_name) as k, cast(c_nationkey as varchar) as icb_code from customer where c_acctbal > 0)
    select o.o_orderkey, l.icb_code from orders o join customer c on c.c_custkey = o.o_custkey left join l on l.k = upper(c.c_name)
""")
def icb_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    listing = c.where("c_acctbal > 0").select(F.lower("c_name").alias("symbol"), F.col("c_nationkey").cast("double").alias("icb_code"), "c_custkey")
    named = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c.select("c_custkey", F.col("c_name").alias("symbol")), "c_custkey")
    return company.with_code(named, listing, "c_custkey").select("o_orderkey", "icb_code")


@query("select l.doc_id, l.quality, d.lang, d.n_chars from labels l left join (select * from documents where source is not null and n_chars > 1000) d on d.doc_id = l.doc_id")
def chunk_details(spark, sf_dir):
    found = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return company.details(found, table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", "lang", "n_chars"), "doc_id")


@query("select distinct 'C' || o_custkey as code from orders where o_orderdate >= timestamp '1999-01-01' and o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1999-01-01')")
def new_codes(spark, sf_dir):
    code = F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code")
    o = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")
    after = o.where(late).select(code).unionByName(o.limit(1).select(F.lit("UNKNOWN").alias("code")))
    return company.new_codes(after, o.where(~late).select(code))


@query("""
    select case when c_custkey % 3 = 0 then 'AB' || c_nationkey when c_acctbal < 0 then 'UNKNOWN' else 'HPG' end as code, count(*) as files from customer group by 1
""")
def code_counts(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ab"), "c_nationkey", F.lit("_2020.pdf"))).when(F.col("c_acctbal") < 0, "2020-1.pdf").otherwise("báo-cáo Hòa Phát.pdf")
    return company.code_counts(table(spark, sf_dir, "customer").select(name.alias("name")))


@query("""
    select '{' || string_agg(n_name || ':' || n, ', ' order by n_name) || '}' as line from (select 'N' || c_nationkey as n_name, count(*) as n from customer group by 1)
""")
def code_counts_line(spark, sf_dir):
    return company.counts_line(company.code_counts(table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("_x.pdf")).alias("name"))))


@query("""
    with p as (select source, case when lang = 'en' then text else ' ' end as t, case when lang = 'fr' then text end as o from documents), q as (select source, trim(t) <> '' as t, o is not null and trim(o) <> '' as o from p)
    select count(distinct source) as files_processed, count(distinct case when o then source end) as files_with_ocr, cast(0 as bigint) as chunks_dropped_garbled, count(*) as pages_total, count(*) filter (where t or o) as pages_with_text,
        count(*) filter (where o) as pages_with_ocr, round(count(*) filter (where o) * 100.0 / count(*), 6) as ocr_rate_on_total_pages_pct, round(count(*) filter (where o) * 100.0 / count(*) filter (where t or o), 6) as ocr_rate_on_text_pages_pct from q
""")
def run_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("source").alias("file"), F.when(F.col("lang") == "en", F.col("text")).otherwise(" ").alias("native"), F.when(F.col("lang") == "fr", F.col("text")).alias("ocr"))
    s = company.run_summary(pages)
    return s.select(*(r(c, 6) if c.endswith("_pct") else c for c in s.columns))


@query("""
    with c as (select 'C' || c_custkey as symbol, c_name as name from customer), f as (select *, case when symbol = 'C12' then 0 when starts_with(symbol, 'C12') then 1 when contains(lower(name), 'c12') then 3 end as fit from c)
    select symbol, name, fit from f where fit is not null order by fit, symbol limit 15
""")
def suggest_companies(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.col("c_name").alias("name"))
    return company.suggested(rows, " c12", 15)


@query("select upper(c_name) as symbol from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def listed_symbols(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.unionByName(c).select(F.concat(F.lit(" "), F.lower("c_name")).alias("id"), F.col("c_mktsegment").alias("exchange"), "c_custkey")
    return company.listed_symbols(rows, "building, MACHINERY", order="c_custkey")


@query("""
    with f as (select cast(o_custkey as varchar) as symbol, cast(year(o_orderdate) as integer) as year, o_orderkey as k from orders where o_orderstatus = 'F'),
    g as (select symbol, year, min(k) as k from f group by 1, 2), n as (select *, row_number() over (partition by symbol order by year desc) as n from g)
    select symbol, year, 'Báo cáo thường niên ' || year as name, 'u' || k as link from n where n <= 2
""")
def report_links(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Báo cáo thường niên "), y)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("Bản cáo bạch, báo cáo thường niên "), y)).otherwise(F.concat(F.lit("Nghị quyết "), y))
    feed = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), name.alias("name"), F.concat(F.lit("u"), "o_orderkey").alias("link"), F.when((F.col("o_orderkey") % 2 == 0) | (y < "2000"), y).otherwise("none").alias("year"), F.col("o_orderkey").alias("ord"))
    return company.report_links(feed, 2)


@query("""
    with m as (select cast(c_custkey as varchar) as symbol, c_acctbal as eps from customer where c_acctbal > 0),
    p as (select cast(o_custkey as varchar) as symbol, cast(year(o_orderdate) as integer) as year, round(sum(o_totalprice), 2) as profit from orders group by 1, 2),
    x as (select symbol, arg_min(profit, year) as a, arg_max(profit, year) as b, max(year) - min(year) as n from p where profit > 0 group by 1), g as (select symbol, case when n > 0 then power(b / a, 1.0 / n) - 1 end as v from x),
    d as (select cast(o_custkey as varchar) as symbol, median(o_totalprice / 1000) as median_pe from orders where o_orderpriority = '1-URGENT' group by 1),
    l as (select cast(o_custkey as varchar) as symbol, arg_max(o_totalprice, o_orderkey) as live_price from orders where o_orderstatus = 'O' group by 1)
    select coalesce(m.symbol, g.symbol, l.symbol) as symbol, m.eps, round(case when v between -0.5 and 1.0 then v end, 6) as cagr, l.live_price, round(d.median_pe, 6) as median_pe, case when c.c_acctbal > 5000 then round(c.c_acctbal / 7, 4) end as forecast_profit,
        'Không lấy được dữ liệu: ' || nullif(array_to_string(list_filter([case when m.symbol is null then 'metrics' end, case when g.symbol is null then 'financial' end, case when l.symbol is null then 'live' end], lambda e: e is not null), '; '), '') as error
    from m full join g on g.symbol = m.symbol full join l on l.symbol = coalesce(m.symbol, g.symbol) left join d on d.symbol = coalesce(m.symbol, g.symbol, l.symbol) left join customer c on cast(c.c_custkey as varchar) = coalesce(m.symbol, g.symbol, l.symbol)
""")
def valuation_assembly(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").withColumn("symbol", F.col("c_custkey").cast("string")), table(spark, sf_dir, "orders").withColumn("symbol", F.col("o_custkey").cast("string"))
    none = F.lit(None).cast("string")
    metrics = c.where("c_acctbal > 0").select("symbol", F.col("c_acctbal").alias("eps"), none.alias("industry_code"), F.col("c_mktsegment").alias("industry_label"))
    profits = o.groupBy("symbol", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("profit"))
    daily = o.where("o_orderpriority = '1-URGENT'").select("symbol", (F.col("o_totalprice") / 1000).alias("pe"), F.lit(None).cast("double").alias("pb"))
    live = o.where("o_orderstatus = 'O'").groupBy("symbol").agg(F.max_by("o_totalprice", "o_orderkey").alias("live_price"))
    made = company.valuation_inputs(metrics, profits, daily, live, c.where("c_acctbal > 5000").select("symbol", F.round(F.col("c_acctbal") / 7, 4).alias("profit_pred")))
    return made.select("symbol", "eps", r("cagr", 6), "live_price", r("median_pe", 6), "forecast_profit", "error")


@query("select conv_id, turn, role || ' hỗ trợ từ biên lợi nhuận ròng, ' || turn || chr(10) || 'một số chỉ tiêu tài chính: x' as message from conversations")
def reader_messages(spark, sf_dir):
    raw = F.concat(F.lit("## **"), "role", F.lit("** tác động tích cực từ net_margin  (other_thing), *"), F.col("turn").cast("string"), F.lit("*\n# a_b: __x__ "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(text.for_readers(raw), " ,", ",").alias("message"))


@query(f"select conv_id, turn, ends_with({_SPACE % 'text'}, '?') or regexp_matches(lower(text), 'bạn muốn|bạn có thể cho|vui lòng cho tôi biết|mã cổ phiếu nào|bạn đang hỏi về') as asks from conversations")
def clarifications(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.asks_back("text").alias("asks"))


@query(f"select doc_id, length(t) as n, md5(t) as digest from (select doc_id, substr({_SPACE % 'text'}, 1, 4000) as t from documents)")
def raw_inputs(spark, sf_dir):
    t = text.raw_input(F.concat(F.lit("\r \x00"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


@query("""
    with u as (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') as path from pages),
    s as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as n from u),
    f as (select page_id, case when n = '' then 'page' else n end as n from s), g as (select page_id, case when ends_with(lower(n), '.pdf') then n else n || '.pdf' end as n from f),
    k as (select *, row_number() over (partition by n order by page_id) - 1 as i from g)
    select page_id, case when i = 0 then n else regexp_replace(n, '\\.[^.]*$', '') || '_' || i || regexp_extract(n, '(\\.[^.]*)$', 1) end as name from k
""")
def page_file_names(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select("page_id", text.file_name_of_url("url", F.lit("page")).alias("name"))
    return text.with_unique_names(named, "name", "page_id")


@query("""
    select conv_id, turn, case when turn % 3 = 0 then '' else role end as content, case when turn % 3 = 0 then null else 'stop' end as finish_reason, case when turn % 3 = 1 then 'search' end as name,
        case when turn % 3 = 1 then case when turn % 2 = 0 then '{"q":' || turn || '}' else '{}' end end as arguments from conversations
""")
def reply_tool_calls(spark, sf_dir):
    turn = F.col("turn")
    call = F.format_string('[{"id":"c%d","function":{"name":"search","arguments":"%s"}}]', turn, F.when(turn % 2 == 0, F.format_string('{\\"q\\":%d}', turn)).when(turn % 4 == 1, "[1]").otherwise("{broken"))
    body = F.when(turn % 3 == 0, '{"choices":[]}').otherwise(F.format_string('{"choices":[{"message":{"content":"%s"%s}}]}', F.col("role"), F.when(turn % 3 == 1, F.concat(F.lit(',"tool_calls":'), call)).otherwise("")))
    made = insights.tool_calls(table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body")))
    return made.select("conv_id", "turn", "content", "finish_reason", F.get("calls", F.lit(0))["name"].alias("name"), F.get("calls", F.lit(0))["arguments"].alias("arguments"))


@query("""
    with m as (select cast(year(o_orderdate) as integer) as year, round(avg(o_totalprice), 4) as price_mean from orders group by 1), c as (select o_orderkey, cast(year(o_orderdate) as integer) as year, o_orderpriority as g from orders)
    select o_orderkey, case when g = '1-URGENT' then price_mean * 1.5 else 0.0 end as "ix_price_mean__URGENT", case when g = '5-LOW' then price_mean * 1.5 else 0.0 end as "ix_price_mean__LOW" from c join m using (year)
""")
def industry_interactions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.regexp_replace("o_orderpriority", "^\\d-", "").alias("g"))
    hot = panel.one_hot(panel.with_macro(o, macro_series(spark, sf_dir)), "g", ["URGENT", "LOW"])
    return panel.industry_interactions(hot, 1.5, {"URGENT": ("price_mean", "missing"), "LOW": ("price_mean",), "OTHER": ("price_mean",)}).select("o_orderkey", "ix_price_mean__URGENT", "ix_price_mean__LOW")


@query(f"""
    with p as ({PANEL}), l as (select *, lag(revenue_current) {W} as a, lead(revenue_current) {W} as b from p)
    select symbol, year, 3 as n_features, true as adds_up from l where revenue_current <> 0 and b is not null
""")
def forecast_contributions(spark, sf_dir):
    """Whether the contributions to each forecast of a customer's next revenue, and their base, add up to the prediction."""
    p = company_panel(spark, sf_dir)
    features = ["revenue_current", "revenue_yoy_pct", "revenue_momentum_pct"]
    rows = forecast.targets(p.withColumns(panel.trend_features(p, "revenue_current", "revenue")).withColumn("revenue_next", F.lead("revenue_current").over(panel.by_symbol())), "revenue_current", "revenue_next")
    model = forecast.regressor(features, trees=5, depth=3, rate=0.3, sample=1.0).fit(rows)
    sums = explain.contributed(model, rows, features, ["symbol", "year"]).groupBy("symbol", "year").agg(F.count("*").cast("int").alias("n_features"), (F.first("base") + F.sum("score")).alias("total"))
    return model.transform(rows).select("symbol", "year", "prediction").join(sums, ["symbol", "year"]).select("symbol", "year", "n_features", (F.abs(F.col("total") - F.col("prediction")) < 1e-9).alias("adds_up"))


@query(f"""
    with p as ({PANEL}), l as (select *, lead(revenue_current) {W} as b from p)
    select year, count(*) as n_rows, true as beats_mean from l where revenue_current <> 0 and b is not null group by year
""")
def boosted_forecast(spark, sf_dir):
    """Regularised boosting of the next revenue's growth; whether its absolute errors are below those of the mean."""
    p = company_panel(spark, sf_dir)
    features = ["revenue_current", "revenue_yoy_pct", "revenue_momentum_pct"]
    rows = forecast.targets(p.withColumns(panel.trend_features(p, "revenue_current", "revenue")).withColumn("revenue_next", F.lead("revenue_current").over(panel.by_symbol())), "revenue_current", "revenue_next")
    model = boosting.fit(rows, features, boosting.Settings(trees=4, depth=3, rate=0.3, bins=32))
    errors = model.transform(rows).select("year", F.abs(F.col("prediction") - F.col("label")).alias("error"), F.abs(model.base - F.col("label")).alias("plain"))
    by_year = errors.groupBy("year").agg(F.count("*").alias("n_rows"))
    beats = errors.agg(F.sum("error") < F.sum("plain")).first()[0]
    return by_year.withColumn("beats_mean", F.lit(beats))


@query()
def batch_forecast(spark, sf_dir):
    """Two data sets (the panels of customers and of suppliers) and two targets, with metrics of each. Small models: the query shows the job."""
    wide = company_panel(spark, sf_dir).withColumn("profit_after_tax", F.col("revenue_current") * (0.05 + F.pmod(F.xxhash64("symbol"), F.lit(10)) / 100))
    window = panel.by_symbol()
    sets = {}
    for name, rows in (("bank", wide), ("nonbank", supplier_panel(spark, sf_dir).drop("total_assets_reported"))):
        full = panel.delta_features(rows)
        full = full.withColumns({"revenue_next": F.lead("revenue_current").over(window), "profit_after_tax_next": F.lead("profit_after_tax").over(window), "debt": F.abs("revenue_momentum_pct"), "rate": F.lit(7.0)})
        sets[name] = (full, ["revenue_yoy_pct", "profit_yoy_pct", "profit_margin_calc_pct", "revenue_roll3_mean", "rate"])
    last = 1999
    detail, _ = forecast.batch(sets, last - 1, last, clip=("revenue_yoy_pct", "profit_yoy_pct"), debt={"nonbank": ("rate", "debt")}, budget={"nonbank": 4}, mandatory=("rate",), trees=3)
    return panel.error_metrics(detail.withColumn("model", F.concat_ws("_", "dataset", "target")), "model", "actual", "predicted")
