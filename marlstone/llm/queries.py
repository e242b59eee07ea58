"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marlstone.llm import dac

    return dac.read(dac.files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.annotated(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import neardup

    return neardup.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import lm

    return lm.scored(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marlstone.llm import bpe

    table_path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encoded(table(spark, sf_dir, "documents"), table_path, pattern)
    return bpe.decoded(ids, table_path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marlstone.llm import packing

    return packing.packed(packing.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import html

    return html.extracted(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import linededup

    done = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import warc

    captures = warc.captures_of(table(spark, sf_dir, "pages"))
    records = captures.select(warc.record(*(F.col(c) for c in ("record_id", "url", "captured_at", "record_type", "headers"))).alias("record"))
    read = written(warc.parsed(records).withColumn("record_id", F.col("record_id").cast("long")), "captures")
    done = warc.resolved(read)
    return done.withColumn("headers", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import media

    return media.described(media.stored(table(spark, sf_dir, "documents"))).drop("thumbnail")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import lexical

    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import resample

    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_lm_scoring, op3_byte_bpe, op4_packing, op5_html_extraction, op6_line_dedup, op7_warc_revisits, op8_media_columns, op9_quality_rules, op10_token_ids, op11_lexical_search, op12_exact_topk, op13_importance_resampling)}

_SPACE = r"[\x20\x09-\x0D]"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op11_lexical_search": f"""
        with found as (
            select doc_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) as term from documents
        ), counted as (
            select doc_id, term, count(*) as tf from found group by all
        ), lengths as (
            select doc_id, cast(sum(tf) as bigint) as n from counted group by doc_id
        ), totals as (
            select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from lengths
        ), df as (
            select term, count(*) as df from counted group by term
        ), asked as (
            select item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) as term from benchmark
        ), weights as (
            select item_id, term, count(*) * any_value(cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint)) as w
            from asked join df using (term) cross join totals group by item_id, term
        ), scores as (
            select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * n_docs) // n_terms))))) as bigint) as score
            from weights join counted using (term) join lengths using (doc_id) cross join totals group by item_id, doc_id
        ), ranks as (
            select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0
        )
        select * from ranks where rank <= 10
    """,
    "op12_exact_topk": """
        with vectors as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scores as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from vectors q join vectors c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
        ), ranks as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scores
        )
        select * from ranks where rank <= 10
    """,
    "op7_warc_revisits": r"""
        with page as (
            select page_id, url, 1704067200 + 60 * page_id as ts, cast(length(html) as varchar) as size, '"' || substr(md5(html), 1, 16) || '"' as tag,
                'day ' || cast(page_id % 97 as varchar) as modified, page_id % 5 = 0 as changed, page_id % 4 <> 0 as tagged
            from pages
        ), captures as (
            select 3 * page_id as record_id, url, ts, true as is_full, 'max-age=60' as cache, modified, size, case when tagged then tag end as etag from page
            union all
            select 3 * page_id + 1, url, ts + 86400 * (1 + page_id % 3), false, 'max-age=120', case when changed and not tagged then 'changed' else modified end, '0',
                case when not tagged then null when changed then '"changed"' when page_id % 7 = 0 then 'W/' || tag else tag end from page
            union all
            select 3 * page_id + 2, url, ts - 1, false, 'max-age=120', modified, '0', null from page where page_id % 11 = 0
        ), bare as (
            select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from captures
        ), keyed as (
            select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '')
                || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
                || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                    lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&'), ''), '') as url_key
            from bare
        ), latest as (
            select r.*, f.record_id as response_id, f.ts as response_at, f.modified as stored_modified, f.etag as stored_etag, f.size as stored_size,
                row_number() over (partition by r.record_id order by f.ts desc, f.record_id desc) as nth
            from keyed r left join keyed f on f.is_full and f.url_key = r.url_key and (f.ts, f.record_id) < (r.ts, r.record_id)
            where not r.is_full
        ), judged as (
            select *, case when response_id is null then 'no_response'
                when etag is not null and coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(stored_etag, '^W/', ''), false) then 'resolved'
                when etag is null and modified = stored_modified then 'resolved' else 'validator_mismatch' end as status
            from latest where nth = 1
        )
        select record_id, url_key, ts as captured_at, response_id, response_at, status,
            'cache-control: ' || cache || chr(10) || 'content-length: ' || case when status = 'resolved' then stored_size else size end || chr(10) || 'date: ' || cast(ts as varchar)
            || coalesce(chr(10) || 'etag: ' || coalesce(etag, case when status = 'resolved' then stored_etag end), '') || chr(10) || 'last-modified: ' || modified as headers
        from judged
    """,
    "op1_ngram_jaccard": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), shingles as (
            select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from words
        ), sizes as (
            select d.doc_id, count(s.g) as n from documents d left join shingles s on s.doc_id = d.doc_id group by d.doc_id
        ), pairs as (
            select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
        ), links as (
            select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)
        ), twoway as (
            select x, y from links union all select y, x from links
        ), reach(a, b) as (
            select doc_id, doc_id from documents union select r.a, e.y from reach r join twoway e on e.x = r.b
        )
        select s.doc_id, any_value(s.n) as n_shingles, min(r.b) as component_id from sizes s join reach r on r.a = s.doc_id group by s.doc_id
    """,
    "op6_line_dedup": f"""
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
            from documents
        ), keyed as (
            select *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines
        ), firsts as (
            select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2
        )
        select k.doc_id, count(*) as n_lines, count(*) filter (where f.first < k.doc_id) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by place) filter (where f.first is null or f.first = k.doc_id), '')) as kept_sha256
        from keyed k left join firsts f on f.key = k.key
        group by k.doc_id
    """,
}
