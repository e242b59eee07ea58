"""Importance resampling towards a target distribution, on position tables of n-grams, with DataFrame functions alone.

Every document is exploded into a table of its words by position; ``lead`` over
the positions gives the following words, and a word with those after it is one
feature of each order, hashed to a bucket.  Rows are dealt by document before they
are exploded, so that whole texts travel once, and neither the window nor the sum
of a document needs another exchange.  Features are counted by bucket, in the raw
documents and in the target's; a bucket's gain is the scaled logarithm of how much
more of the target it makes up, and joins the position table again.  A document's
weight is the sum of its features' gains.  Gumbel noise from a hash of the id turns
weights into scores whose highest ones are a sample without replacement.

The highest scores are ranked without gathering them: rows are dealt into ranges
of scores, counted by range, and numbered within each.

Defined cases: a null or empty text, or one without words, has no features and the
weight 0; a null id has the noise of the id "", and comes last among equal scores;
repeated rows are documents each; documents of fewer than ``LEAST_WORDS`` words are
never drawn; without target texts all buckets have target counts of 0; an empty
table gives no rows; other columns play no part; a very long text is exploded by
one task, which sorts its words and spills if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import written

ORDERS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
#: Percent of the documents long enough that are drawn.
PERCENT = 5
SEED = 42
SCALE = 1000
#: What lies between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def positions(docs: DataFrame, id_col: str, text_col: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, id, word, b1, b2, ...): a row for each word with the bucket of the feature of each order that starts there, null where the text ends before.

    A document without words has one row without a word.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartition("row")
    # Extracting all matches copies the text for each of them; splitting doesn't.
    words = F.array_remove(F.split(F.translate("text", _UPPER, _LOWER), _BETWEEN), "")
    table = texts.select("row", "id", F.posexplode_outer(words).alias("pos", "word"))
    order = Window.partitionBy("row").orderBy("pos")
    following = [F.lead("word", k).over(order).alias(f"w{k}") for k in range(1, orders)]
    table = table.select("row", "id", "word", *following)

    def bucket(n: int) -> Column:
        feature = F.concat_ws(" ", "word", *(f"w{k}" for k in range(1, n)))
        last = F.col("word") if n == 1 else F.col(f"w{n - 1}")
        return F.when(last.isNotNull(), (F.crc32(feature.cast("binary")) % buckets).cast("int"))

    return table.select("row", "id", "word", *(bucket(n).alias(f"b{n}") for n in range(1, orders + 1)))


def bucket_counts(table: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): features in each bucket."""
    return table.select(F.explode(F.array(*(f"b{n}" for n in range(1, orders + 1)))).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from counts (bucket, n): at most ``buckets`` rows, written."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    both = written(both, "bucket-counts")
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return written(both.join(F.broadcast(sums)).select("bucket", F.floor(SCALE * F.log(ratio)).alias("gain")), "gains")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise, scaled and floored, from 32 bits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / 4294967296)))


def weighted(table: DataFrame, gain: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(row, id, n_words, n_features, weight) of each document of a position table."""
    total, many = F.lit(0).cast("long"), F.lit(0).cast("long")
    for n in range(1, orders + 1):
        table = table.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
        total = total + F.coalesce(F.col(f"g{n}"), F.lit(0))
        many = many + F.col(f"b{n}").isNotNull().cast("long")
    return table.groupBy("row", "id").agg(F.count("word").alias("n_words"), F.sum(many).alias("n_features"), F.sum(total).alias("weight"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, from 1 in the given order, which no two rows may share. No task holds more than a range of them."""
    dealt = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range
    starts = dealt.groupBy("part").agg(F.count("*").alias("many")).select("part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + number).drop("part", "before")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null for those that aren't drawn."""
    table = positions(docs, id_col, text_col, orders, buckets)
    theirs = positions(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", orders, buckets)
    gain = gains(bucket_counts(table, orders), bucket_counts(theirs, orders), buckets)
    scored = written(weighted(table, gain, orders).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    # the row's number keeps rows of one id apart
    numbered = ranked(long_enough, [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")])
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    done = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).unionByName(short)
    return done.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
