"""Numeric column expressions. Missing is NULL, never NaN or infinite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """A double without NaN and infinities."""
    c = _c(x).try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def log1p_nonneg(x: Column | str) -> Column:
    """log1p of the value, negatives as 0; NULL stays NULL (greatest alone would skip it)."""
    c = _c(x)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def clip(x: Column | str, low: Column | float | None, high: Column | float | None) -> Column:
    """Between bounds; NULL stays NULL, a NULL bound doesn't bind."""
    c = _c(x)
    bound = [b if isinstance(b, Column) else F.lit(b).cast("double") for b in (low, high)]
    return F.when(c.isNotNull(), F.least(F.greatest(c, bound[0]), bound[1]))


def signed_log_growth(current: Column | str, following: Column | str) -> Column:
    """sign(g) ln(1 + |g|) of g = following / current - 1; NULL where it isn't defined."""
    g = F.try_divide(_c(following).cast("double"), F.nullif(_c(current).cast("double"), F.lit(0.0))) - 1
    return F.signum(g) * F.log1p(F.abs(g))


def grown(current: Column | str, target: Column | str) -> Column:
    """The inverse: the value that a predicted signed log growth, limited to 3 either way, leads to; 0 where unknown."""
    p = F.least(F.greatest(_c(target), F.lit(-3.0)), F.lit(3.0))
    return F.when(_c(target).isNull() | _c(current).isNull(), 0.0).otherwise(_c(current) * (1 + F.signum(p) * F.expm1(F.abs(p))))


def percent_change(current: Column | str, reference: Column | str) -> Column:
    return F.try_divide(_c(current) - _c(reference), F.nullif(_c(reference), F.lit(0.0))) * 100


def status_label(diff_percent: Column, threshold: float = 3.0) -> Column:
    return F.when(diff_percent > threshold, "OVERVALUED").when(diff_percent < -threshold, "UNDERVALUED").when(diff_percent.isNotNull(), "FAIR")


#: What a live multiple is called against its history.
VIEWS = ("rẻ tương đối", "hơi rẻ", "gần trung vị lịch sử", "hơi đắt", "đắt tương đối")


def relative_view(live: Column | str, median: Column | str) -> Column:
    """Cheap or dear against the median, bounds inclusive; NULL without both or with a zero median."""
    m = F.nullif(_c(median), F.lit(0.0))
    d = (_c(live) - m) / F.abs(m)
    return F.when(d <= -0.15, VIEWS[0]).when(d <= -0.05, VIEWS[1]).when(d >= 0.15, VIEWS[4]).when(d >= 0.05, VIEWS[3]).when(d.isNotNull(), VIEWS[2])


def shares_in_billions(x: Column | str) -> Column:
    """Share counts come in units, thousands of millions or billions; the magnitude tells."""
    c = _c(x)
    return F.when(F.abs(c) >= 1e6, c / 1e9).when(F.abs(c) >= 1e3, c / 1e3).otherwise(c)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sha1_shard(x: Column | str, shards: int) -> Column:
    """The first 8 bytes of the SHA-1, big-endian, modulo the number of shards."""
    return (F.conv(F.substring(F.sha1(_c(x).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)") % shards).cast("int")


#: Fixed value: the URL namespace of RFC 4122.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column | str) -> Column:
    """The version-5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), _c(name).cast("binary")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8).cast("string"), 10, 16))
    parts = [F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)]
    return reduce(lambda a, b: F.concat(a, b), parts)
