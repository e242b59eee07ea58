"""Why a tree ensemble predicts what it does: Shapley values of the features of every row.

A tree is a set of arrays.  Each leaf gives its value to the features on its path:
a feature has, per row, whether the row meets all its conditions on the path, and,
for rows without it, the share of training weight that goes that way.  The mean
over all orders of features is a polynomial of these two numbers, of a degree no
higher than the path is deep, so a batch of rows is worked out leaf by leaf with no
loop over rows or subsets.  What features a tree doesn't use get nothing; the base
is the ensemble's mean over its training rows, and base and contributions add up to
the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf's value, how it is reached (feature, highest value below or lowest above, share of weight), and its share of all weight."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray

    @property
    def share(self) -> float:
        return float(np.prod(self.shares))


def leaves_of(node, low: dict[int, float] | None = None, high: dict[int, float] | None = None, shares: dict[int, float] | None = None) -> list[Leaf]:
    """Of a node given as (value, weight) or (feature, threshold, left, right, weight); values up to the threshold go left.

    Conditions on one feature are joined: a row must be above ``low`` and not above ``high``.
    """
    low, high, shares = low or {}, high or {}, shares or {}
    if len(node) == 2:
        used = sorted(shares)
        at = lambda of, default: np.array([of.get(f, default) for f in used])
        return [Leaf(node[0], np.array(used, np.int64), at(low, -np.inf), at(high, np.inf), at(shares, 1.0))]
    feature, threshold, left, right, weight = node
    out = []
    for child, is_left in ((left, True), (right, False)):
        part = child[-1] / weight if weight > 0 else 0.5
        more = shares | {feature: shares.get(feature, 1.0) * part}
        if is_left:
            out += leaves_of(child, low, high | {feature: min(high.get(feature, np.inf), threshold)}, more)
        else:
            out += leaves_of(child, low | {feature: max(low.get(feature, -np.inf), threshold)}, high, more)
    return out


def ensemble_of(model) -> list[tuple[float, list[Leaf]]]:
    """(weight, leaves) of each tree of a fitted model of boosted trees, of a forest (whose mean is the prediction) or of one tree."""
    if hasattr(model, "ensemble"):
        return model.ensemble()

    def read(node):
        weight = node.impurityStats().count()
        if node.subtreeDepth() == 0:
            return node.prediction(), weight
        split = node.split()
        if not hasattr(split, "threshold") or split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("splits on categories have no thresholds")
        return split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild()), weight

    trees = getattr(model, "trees", [model])
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1 / len(trees)] * len(trees)
    return [(w, leaves_of(read(t._java_obj.rootNode()))) for w, t in zip(weights, trees, strict=True)]


def base_of(ensemble: Sequence[tuple[float, list[Leaf]]]) -> float:
    return float(sum(w * leaf.value * leaf.share for w, leaves in ensemble for leaf in leaves))


def contributions(ensemble: Sequence[tuple[float, list[Leaf]]], rows: np.ndarray) -> np.ndarray:
    """Shapley values, a row a row and a column a feature."""
    out = np.zeros(rows.shape)
    for weight, leaves in ensemble:
        for leaf in leaves:
            m = len(leaf.features)
            if not m:
                continue
            values = rows[:, leaf.features]
            with np.errstate(invalid="ignore"):
                # what is no number goes right, as in the model
                met = (np.isnan(values) & np.isposinf(leaf.high) | ~np.isnan(values) & (values > leaf.low) & (values <= leaf.high)).astype(np.float64)
            order = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            for j in range(m):
                # coefficient k: over the sets of k other features, what they make of the leaf if just they are known
                known = np.zeros((len(rows), m))
                known[:, 0] = 1
                for i in range(m):
                    if i != j:
                        known[:, 1:] = known[:, 1:] * leaf.shares[i] + known[:, :-1] * met[:, i : i + 1]
                        known[:, 0] *= leaf.shares[i]
                out[:, leaf.features[j]] += weight * leaf.value * (met[:, j] - leaf.shares[j]) * (known @ order)
    return out


def contributed(model, rows: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, base, feature, score) for every row and feature, from trees or a pipeline whose last stage is trees; null features count as 0.

    Repeated rows are explained each; an empty table gives no rows.
    """
    last = model.stages[-1] if hasattr(model, "stages") else model
    ensemble, names = ensemble_of(last), list(features)
    base = base_of(ensemble) + getattr(last, "base", 0.0)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([batch.column(len(key) + i).to_numpy(zero_copy_only=False) for i in range(len(names))]) if names else np.zeros((batch.num_rows, 0))
            scores = contributions(ensemble, table)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(names)), pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(key))), lists], [*key, "scores"])

    values = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f"__{i}") for i, f in enumerate(names)]
    found = rows.select(*key, *values).mapInArrow(run, f"{kinds}, scores array<double>")
    named = F.inline(F.arrays_zip(F.array(*(F.lit(f) for f in names)).alias("feature"), F.col("scores").alias("score")))
    return found.select(*key, F.lit(base).alias("base"), named)
