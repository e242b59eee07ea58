"""Queries of page files, paged records, runs over fetched files, forecast requests and the block index, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import answers, blocks, ingest
from marlstone.plans.queries import PANEL, POSTINGS, TOKENS, _garbled, _strip, company_panel, query, r, table
from marlstone.sources import pagefiles
from marlstone.sources.store import scratch
from marlstone.streaming.content import ContentLog


@query("select md5(replace(coalesce(text, ''), chr(12), ' ')) as digest, count(*) as n, 0 as n_errors from documents group by 1")
def page_files(spark, sf_dir):
    """All documents written as files of pages, one after the other, and read back page by page; small shares, so that files are cut."""
    path = scratch(spark, "pages")
    table(spark, sf_dir, "documents").select(F.translate(F.coalesce("text", F.lit("")), "\f", " ").alias("text")).write.option("lineSep", "\f").text(path)
    pagefiles.register(spark, {"text": pagefiles.form_feed_pages})
    pages = spark.read.format("pagefiles").option("path", path).option("pattern", "part-*").option("partitionBytes", 16 << 20).load()
    return pages.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).cast("int").alias("n_errors"))


@query("""
    with b as (select l_orderkey, round(l_extendedprice / 100000, 1) as y, l_quantity as x, trim(l_returnflag || ' ' || l_linestatus || l_linenumber) as t from lineitem)
    select l_orderkey, string_agg(t, chr(10) order by y, x, t) as text, cast(count(*) as integer) as n_lines from b group by 1
""")
def page_reading_order(spark, sf_dir):
    """An order is a page, its lines are boxes: bands of rounded distance from the upper edge, each read from the left."""
    words = F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.col("l_linenumber").cast("string"))
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 100000).alias("top"), F.col("l_quantity").alias("left"), words.alias("text"))
    return pagefiles.reading_order(boxes, ["l_orderkey"], F.col("top"), F.col("left"), places=1).select("l_orderkey", "text", "n_lines")


@query("""
    with d as (select 'doc/' || doc_id as url, md5(text) as digest, doc_id as t, case when text is null then 'x' end as error, 0 as batch from documents),
    g as (select 'page/' || page_id as url, md5(html) as digest, page_id as t, null as error, 1 as batch from pages),
    a as (select * from d union all select * from g union all select url, digest, t, error, 2 from d), s as (select *, row_number() over (partition by digest order by batch, t, url) as k from a)
    select batch, url, case when error is not null or digest is null then 'failed' when k = 1 then 'downloaded' else 'deduplicated' end as status from s
""")
def content_statuses(spark, sf_dir):
    """Three runs: the documents as files, the pages, and the documents again, which by then are all known."""
    log = ContentLog(spark, scratch(spark, "content"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("url"), F.md5("text").alias("digest"), F.timestamp_seconds("doc_id").alias("at"), F.when(F.col("text").isNull(), "no text").alias("error"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("url"), F.md5("html").alias("digest"), F.timestamp_seconds("page_id").alias("at"), F.lit(None).cast("string").alias("error"))
    for number, batch in enumerate((docs, pages, docs)):
        log.record(batch, number)
    return log.log().select(F.col("batch").cast("int").alias("batch"), "url", "status", F.explode(F.sequence(F.lit(1), "n")).alias("__k")).drop("__k")


SEARCHES = (("license",), ("the", "tion", "der", "license"), ("government", "energy", "und"))


@query(f"""
    with p as ({POSTINGS}), q as (select unnest({[i for i, s in enumerate(SEARCHES) for _ in s]}) as search, unnest({[w for s in SEARCHES for w in s]}) as token),
    l as (select doc_id, len({TOKENS}) as len from documents), s as (select count(*) as n, avg(len) as av from l), d as (select token, count(*) as df from p group by 1),
    f as (select q.search, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))), 6) as score from p join q using (token) join d using (token) join l using (doc_id), s group by 1, 2),
    k as (select *, row_number() over (partition by search order by score desc, doc_id) as rank from f)
    select search, doc_id, score from k where rank <= 20
""")
def bm25_index_topk(spark, sf_dir):
    """Searches over one index of blocks; a few more than asked for are taken before rounding, which decides ties."""
    index = blocks.BlockIndex.build(table(spark, sf_dir, "documents"), scratch(spark, "blocks"), "doc_id", "text", buckets=16)
    out = None
    for i, words in enumerate(SEARCHES):
        found = index.top(words, 40).select(F.lit(i).alias("search"), "doc_id", r("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""
    with p as ({PANEL}), c as (select cast(c_custkey as varchar) as symbol, c_mktsegment = 'BUILDING' as reported, c_acctbal >= 0 as bundled from customer),
    q as (select o_orderkey as request_id, cast(o_custkey as varchar) as symbol, cast(year(o_orderdate) as integer) as y, o_orderstatus as s from orders), early as (select distinct symbol, y from q where s = 'F'),
    rows as (select symbol, year + 1 as ty, year as fy, revenue_current * 1.1 as rp from p join c using (symbol) where reported),
    k as (select symbol, y, arg_max(fy, (case when ty = y then 10000 else 0 end) + ty) as fy, arg_max(rp, (case when ty = y then 10000 else 0 end) + ty) as rp from (select distinct symbol, y from q) join rows using (symbol) group by 1, 2),
    z as (select symbol, max(year) as fy, arg_max(revenue_current, year) * 1.05 as rp from p group by 1)
    select q.request_id, q.symbol, q.y as predict_target_year, coalesce(k.fy, case when bundled then z.fy end) as feature_year, round(coalesce(k.rp, case when bundled then z.rp end), 4) as revenue_pred,
        case when k.symbol is not null then 'report' when bundled and early.symbol is not null then 'cache' when bundled then 'computed' end as tier, case when k.symbol is null and not coalesce(bundled, false) then 'FORECAST_SYMBOL_NOT_FOUND' end as error_code
    from q left join c using (symbol) left join k on k.symbol = q.symbol and k.y = q.y left join z on z.symbol = q.symbol left join early on early.symbol = q.symbol and early.y = q.y
""")
def forecast_answers(spark, sf_dir):
    """Every order asks for its customer's forecast of its year. Closed orders ask first, so that their computed answers are in the cache when all ask."""
    p = company_panel(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), "c_mktsegment", "c_acctbal")
    report = p.join(customers.where("c_mktsegment = 'BUILDING'"), "symbol").select("symbol", (F.col("year") + 1).alias("target_year"), F.col("year").alias("feature_year"), (F.col("revenue_current") * 1.1).alias("revenue_pred"), F.col("year").alias("ord"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit(" "), "o_custkey").alias("symbol"), F.year("o_orderdate").alias("target_year"), "o_orderstatus")
    latest = p.groupBy("symbol").agg(F.max("year").alias("feature_year"), (F.max_by("revenue_current", "year") * 1.05).alias("revenue_pred"))

    def compute(missing):
        return missing.join(latest, "symbol").withColumn("target_year", F.col("wanted_year"))

    store = answers.cache(spark, scratch(spark, "cache"), 8)
    bundles = customers.where("c_acctbal >= 0").select("symbol", F.col("c_mktsegment").alias("digest"))
    answers.answered(asked.where("o_orderstatus = 'F'"), report, report.limit(0), store, bundles, compute)
    out = answers.answered(asked, report, report.limit(0), store, bundles, compute)
    return out.select("request_id", "symbol", "predict_target_year", "feature_year", r("revenue_pred"), "tier", "error_code")


@query("""
    with w as (select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT'))
    select c_custkey, (row_number() over (order by c_custkey) - 1) // 20 as page_no from w
""")
def pending_pages(spark, sf_dir):
    """Customers without urgent orders, in pages of 20 by key."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    left = ingest.pending(customers, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return ingest.paged(left, "c_custkey", 20, scratch(spark, "paged"))


@query(f"""
    with g as ({_garbled('documents', 'doc_id, source, text', 'text')}), b as (select doc_id, source, {_strip("coalesce(text, '')")} = '' as blank, coalesce(garbled, false) as garbled from g),
    f as (select source, count(*) filter (where not blank) as n, count(*) filter (where not blank and garbled) as bad from b group by 1)
    select doc_id, blank or garbled or coalesce(n > 0 and bad >= 0.3 * n, false) as reread from b left join f using (source)
""")
def page_reread(spark, sf_dir):
    """A source's documents as the pages of its file."""
    return pagefiles.reread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), file_col="source").select("doc_id", "reread")
