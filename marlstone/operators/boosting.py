"""Regularised gradient boosting of second order, whose histograms are Spark aggregations.

Features are cut into at most ``bins`` bins once.  A tree is grown level by level:
gradients and Hessians are summed by node, feature and bin, which is all that comes
to the driver (2**depth * features * bins rows at most, whatever the input), and the
driver chooses each node's split.  The loss is squared or absolute; for the absolute
one, leaves hold medians of what is left.  alpha and lambda shrink leaves; each tree
sees a part of the rows, by a hash of their values, and a part of the columns.

Margins are written to the scratch folder every ``KEPT`` trees, which bounds the
plan and what lost executors cost.  Trees are column expressions for scoring.

Defined cases: null features count as 0; rows without a label, or with weight 0 or
less, take no part in fitting; without rows to fit the prediction is 0; equal rows
are sampled together; of equal gains the first feature and the lowest bin win.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import explain
from marlstone.sources.store import scratch

#: Trees that a plan holds before the margins are written.
KEPT = 8


@dataclass(frozen=True)
class Settings:
    trees: int = 450
    depth: int = 4
    rate: float = 0.03
    sample: float = 0.9
    columns: float = 0.9
    alpha: float = 0.2
    lam: float = 2.0
    bins: int = 64
    least_weight: float = 1.0
    absolute: bool = False
    seed: int = 42


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node's histograms (feature, bin); None if nothing is gained."""
    left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    worth = lambda a, b: shrunk(a, s.alpha) ** 2 / (b + s.lam)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
    gain[(left_h < s.least_weight) | (all_h - left_h < s.least_weight) | ~np.isfinite(gain)] = -1.0
    at = int(np.argmax(np.round(gain, 9)))  # sums differ in their last digits with the order of rows
    feature, bin_ = divmod(at, g.shape[1])
    return (float(gain[feature, bin_]), feature, bin_) if gain[feature, bin_] > 1e-9 else None


def chosen_columns(n: int, tree: int, s: Settings) -> list[int]:
    many = max(1, round(n * s.columns))
    return sorted(np.random.default_rng([s.seed, tree]).permutation(n)[:many].tolist())


@dataclass
class Boosted:
    """Trees as (value, weight) and (feature, threshold, left, right, weight), the base they are added to, and each feature's gain."""

    features: list[str]
    base: float
    trees: list = field(default_factory=list)
    gains: list[float] = field(default_factory=list)

    def _inputs(self) -> list[Column]:
        return [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in self.features]

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with prediction. The trees' sum is cut into short expressions, which are compiled one by one."""
        out = rows.withColumn("__x", F.array(*self._inputs())).withColumn("prediction", F.lit(self.base))
        for k in range(0, len(self.trees), KEPT):
            part = F.lit(0.0)
            for tree in self.trees[k : k + KEPT]:
                part = part + tree_column(tree, lambda f: F.col("__x")[f])
            out = out.withColumn("prediction", F.col("prediction") + part)
        return out.drop("__x")

    def ensemble(self) -> list:
        return [(1.0, explain.leaves_of(t)) for t in self.trees]

    @property
    def importances(self) -> np.ndarray:
        total = sum(self.gains)
        return np.array(self.gains) / total if total else np.zeros(len(self.features))

    def save(self, path: str) -> None:
        SparkSession.getActiveSession().createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> Boosted:
        return cls(**json.loads(SparkSession.getActiveSession().read.text(path, wholetext=True).first()[0]))


def tree_column(node, value_of) -> Column:
    if len(node) == 2:
        return F.lit(float(node[0]))
    feature, threshold, left, right, _ = node
    return F.when(value_of(feature) <= F.lit(float(threshold)), tree_column(left, value_of)).otherwise(tree_column(right, value_of))


def cut_points(rows: DataFrame, n: int, bins: int) -> list[list[float]]:
    """Ascending values of each entry of the array x; a value belongs to the bin of the first that isn't below it, or to the last bin."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.agg(*(F.approx_percentile(F.col("x")[i], shares, F.lit(10_000)).alias(f"c{i}") for i in range(n))).first()
    return [sorted(set(c or [])) for c in found]


def fit(rows: DataFrame, features: Sequence[str], settings: Settings = Settings(), label: str = "label", weight: str | None = None) -> Boosted:
    s, names = settings, list(features)
    model = Boosted(names, 0.0, gains=[0.0] * len(names))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    table = rows.select(F.array(*model._inputs()).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w")).where("y is not null and not isnan(y) and w > 0")
    where, step = scratch(rows.sparkSession, "boosting"), 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.parquet(f"{where}/{step}")
        return rows.sparkSession.read.schema(df.schema).parquet(f"{where}/{step}")

    table = kept(table)
    first = table.agg(F.approx_percentile("y", 0.5, F.lit(10_000)) if s.absolute else F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
    if first is None:
        return model
    model.base = float(first)
    cuts = cut_points(table, len(names), s.bins)
    place = F.array(*(F.size(F.filter(F.array(*map(F.lit, c)), lambda v: v < F.col("x")[i])) if c else F.lit(0) for i, c in enumerate(cuts)))
    table = kept(table.select(place.alias("b"), "y", "w", F.xxhash64("x", "y").alias("key"), F.lit(model.base).alias("m")))
    for t in range(s.trees):
        error = F.col("m") - F.col("y")
        seen = table.where(F.pmod(F.xxhash64("key", F.lit(s.seed + t)), F.lit(10_000)) < round(10_000 * s.sample)) if s.sample < 1 else table
        seen = seen.withColumns({"g": F.col("w") * (F.signum(error) if s.absolute else error), "h": F.col("w")})
        tree, splits, leaf_of = _grown(seen, cuts, chosen_columns(len(names), t, s), s, model.gains)
        if s.absolute:
            medians = {r["leaf"]: r["median"] for r in seen.groupBy(leaf_of.alias("leaf")).agg(F.approx_percentile(F.col("y") - F.col("m"), 0.5, F.lit(10_000)).alias("median")).collect()}
            tree = _with_values(tree, {k: s.rate * v for k, v in medians.items()}, 0)
        model.trees.append(tree)
        table = table.withColumn("m", F.col("m") + _by_bins(tree, splits, 0))
        if (t + 1) % KEPT == 0:
            table = kept(table)
    return model


def _grown(rows: DataFrame, cuts: list[list[float]], columns: list[int], s: Settings, gains: list[float]) -> tuple[tuple, dict, Column]:
    """A tree, its splits by node number (root 0, children 2n + 1 and 2n + 2), and the column of a row's leaf number."""
    splits: dict[int, tuple[int, int]] = {}
    sums: dict[int, tuple[float, float]] = {}
    open_ = [0]
    width = max((len(cuts[c]) for c in columns), default=0) + 1
    for _ in range(s.depth):
        pairs = F.posexplode(F.array(*(F.col("b")[c] for c in columns))).alias("column", "bin")
        found = rows.withColumn("node", _leaf(splits)).where(F.col("node").isin(open_)).select("node", "g", "h", pairs).groupBy("node", "column", "bin").agg(F.sum("g"), F.sum("h")).collect()
        table = {n: np.zeros((2, len(columns), width)) for n in open_}
        for node, column, bin_, g, h in found:
            table[node][:, column, bin_] = g, h
        after = []
        for node in open_:
            g, h = table[node]
            sums.setdefault(node, (float(g[0].sum()), float(h[0].sum())))
            best = best_split(g, h, s)
            if best is None:
                continue
            gain, column, bin_ = best
            splits[node] = (columns[column], bin_)
            gains[columns[column]] += gain
            for child, part in ((2 * node + 1, slice(None, bin_ + 1)), (2 * node + 2, slice(bin_ + 1, None))):
                sums[child] = (float(g[column, part].sum()), float(h[column, part].sum()))
                after.append(child)
        open_ = after
        if not open_:
            break

    def node(n: int):
        g, h = sums.get(n, (0.0, 0.0))
        if n not in splits:
            return float(-s.rate * shrunk(g, s.alpha) / (h + s.lam)) if h + s.lam > 0 else 0.0, h
        column, bin_ = splits[n]
        return column, cuts[column][bin_], node(2 * n + 1), node(2 * n + 2), h

    return node(0), splits, _leaf(splits)


def _leaf(splits: dict[int, tuple[int, int]], n: int = 0) -> Column:
    if n not in splits:
        return F.lit(n)
    column, bin_ = splits[n]
    return F.when(F.col("b")[column] <= bin_, _leaf(splits, 2 * n + 1)).otherwise(_leaf(splits, 2 * n + 2))


def _by_bins(node, splits: dict[int, tuple[int, int]], n: int) -> Column:
    if len(node) == 2:
        return F.lit(float(node[0]))
    column, bin_ = splits[n]
    return F.when(F.col("b")[column] <= bin_, _by_bins(node[2], splits, 2 * n + 1)).otherwise(_by_bins(node[3], splits, 2 * n + 2))


def _with_values(node, values: dict[int, float], n: int):
    if len(node) == 2:
        return float(values.get(n, 0.0)), node[1]
    return (*node[:2], _with_values(node[2], values, 2 * n + 1), _with_values(node[3], values, 2 * n + 2), node[4])
