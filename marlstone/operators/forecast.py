"""Forecasts: boosted trees, feature elimination, recursion over years, drivers, reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import num
from marlstone.operators import boosting, explain, panel


def targets(df: DataFrame, current: str, following: str) -> DataFrame:
    """Rows with a valid pair, with the signed log growth as label."""
    return df.where(F.col(current).isNotNull() & F.col(following).isNotNull() & (F.col(current) != 0)).withColumn("label", num.signed_log_growth(current, following))


def regressor(features: Sequence[str], absolute: bool = False, weight: str | None = None, trees: int = 450, depth: int = 4, rate: float = 0.03, sample: float = 0.9):
    """A pipeline of vector assembly and gradient-boosted trees; NULL features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = SQLTransformer(statement="select *, " + ", ".join(f"coalesce(cast(`{f}` as double), 0.0) as `__{f}`" for f in features) + " from __THIS__")
    trees_ = GBTRegressor(labelCol="label", featuresCol="features", lossType="absolute" if absolute else "squared", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=42)
    if weight:
        trees_ = trees_.setWeightCol(weight)
    return Pipeline(stages=[filled, VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="features"), trees_])


def eliminated(train: DataFrame, candidates: Sequence[str], most: int, mandatory: Sequence[str] = (), step: float = 0.15, trees: int = 220, weight: str | None = None) -> list[str]:
    """Recursive elimination by importance: each round drops a fixed share of the first number until ``most`` are left."""
    fixed = [c for c in mandatory if c in candidates]
    left = [c for c in candidates if c not in fixed]
    keep, drop = max(0, min(most - len(fixed), len(left))), max(1, int(step * len(left)))
    while len(left) > keep > 0:
        model = regressor(left, weight=weight, trees=trees, rate=0.05).fit(train).stages[-1]
        worth = dict(zip(left, model.featureImportances.toArray(), strict=True))
        gone = sorted(left, key=lambda c: worth[c])[: min(drop, len(left) - keep)]
        left = [c for c in left if c not in gone]
    return fixed + (left if keep else [])


def predicted(model, rows: DataFrame, current: str) -> DataFrame:
    """The model's growth turned back into a value."""
    return model.transform(rows).withColumn("predicted", num.grown(current, "prediction"))


def recursive(base: DataFrame, step: Callable[[DataFrame, int], DataFrame], first: int, last: int, actual: DataFrame | None = None) -> DataFrame:
    """(symbol, year, revenue, profit_after_tax, source) for all symbols at once, one step a year.

    base: symbol, revenue_current, revenue_lag1, revenue_lag2 and the same of profit, at year ``first``.  ``step`` adds
    revenue_next and profit_next and keeps the other columns.  Where actual (symbol, year, revenue, profit_after_tax) has a row, it is the next state.
    """
    if last < first:
        raise ValueError("the last year is before the first")
    at = lambda year, revenue, profit, source: F.struct(F.lit(year).alias("year"), F.col(revenue).alias("revenue"), F.col(profit).alias("profit_after_tax"), F.lit(source).alias("source"))
    # The years travel with the state: one pass, where a union of all steps would compute each year anew for every later one.
    state = base.withColumn("__years", F.array(at(first, "revenue_current", "profit_after_tax", "base")))
    for year in range(first + 1, last + 1):
        moved = step(derived_state(state), year - 1)
        moved = moved.withColumn("__years", F.array_append("__years", at(year, "revenue_next", "profit_next", "predicted")))
        if actual is not None:
            known = actual.where(F.col("year") == year).select("symbol", F.col("revenue").alias("__r"), F.col("profit_after_tax").alias("__p"))
            moved = moved.join(known, "symbol", "left").withColumns({"revenue_next": F.coalesce("__r", "revenue_next"), "profit_next": F.coalesce("__p", "profit_next")})
        state = moved.select("symbol", F.col("revenue_next").alias("revenue_current"), F.col("revenue_current").alias("revenue_lag1"), F.col("revenue_lag1").alias("revenue_lag2"), F.col("profit_next").alias("profit_after_tax"), F.col("profit_after_tax").alias("profit_lag1"), F.col("profit_lag1").alias("profit_lag2"), "__years")
    return state.select("symbol", F.inline("__years"))


def derived_state(state: DataFrame) -> DataFrame:
    """A state's derived features. Unlike in training, a missing lag counts as 0 in means and deviations of three points."""
    more = {}
    for c, name in (("revenue_current", "revenue"), ("profit_after_tax", "profit")):
        a, b, d = (F.coalesce(F.col(x), F.lit(0.0)) for x in (c, f"{name}_lag1", f"{name}_lag2"))
        mean = (a + b + d) / 3
        more[f"{name}_roll3_mean"] = mean
        more[f"{name}_roll3_std"] = F.sqrt((F.pow(a - mean, F.lit(2.0)) + F.pow(b - mean, F.lit(2.0)) + F.pow(d - mean, F.lit(2.0))) / 3)
        more[f"{name}_yoy_pct"] = F.when(b != 0, (a / F.nullif(b, F.lit(0.0)) - 1) * 100).otherwise(0.0)
        more[f"{name}_momentum_pct"] = F.when(b != 0, (a - b) / F.nullif(F.abs(b), F.lit(0.0)) * 100).otherwise(0.0)
    more["profit_margin_calc_pct"] = panel.margin("profit_after_tax", "revenue_current")
    more["revenue_momentum_delta"] = F.col("revenue_current") - F.coalesce("revenue_lag1", F.lit(0.0))
    return state.withColumns(more)


def driver_shares(drivers: DataFrame, k: int) -> DataFrame:
    """drivers (symbol, target, year, feature, score) with each year's share of the absolute scores, its change against the year before, trend, direction, and the k best."""
    group = Window.partitionBy("symbol", "target", "year")
    shares = drivers.withColumn("share_pct", F.try_divide(F.abs("score"), F.nullif(F.sum(F.abs("score")).over(group), F.lit(0.0))) * 100)
    before = shares.select("symbol", "target", "feature", (F.col("year") + 1).alias("year"), F.col("share_pct").alias("previous_pct"))
    both = shares.join(before, ["symbol", "target", "feature", "year"], "left").withColumn("delta_pct", F.col("share_pct") - F.col("previous_pct"))
    trend = F.when(F.col("delta_pct") > 1e-12, "UP").when(F.col("delta_pct") < -1e-12, "DOWN").when(F.col("delta_pct").isNotNull(), "FLAT")
    direction = F.when(F.col("score") > 0, "POSITIVE").when(F.col("score") < 0, "NEGATIVE").otherwise("NEUTRAL")
    ranked = both.withColumns({"trend": trend, "direction": direction, "rank": F.row_number().over(group.orderBy(F.desc(F.abs("score")), "feature"))})
    return ranked.where(F.col("rank") <= k)


def drivers_of(model, rows: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, feature, score, method): contributions to the prediction; importance times the value's size where the last stage is no ensemble of trees, or the size alone where it has no importances."""
    if not hasattr(model, "stages") or hasattr(model.stages[-1], "trees") or hasattr(model.stages[-1], "depth"):
        return explain.contributed(model, rows, features, key).select(*key, "feature", "score", F.lit("shap_contrib").alias("method"))
    method = "importance_x_abs_value" if hasattr(model.stages[-1], "featureImportances") else "abs_feature_value"
    worth = model.stages[-1].featureImportances.toArray() if hasattr(model.stages[-1], "featureImportances") else [1.0] * len(features)
    scores = F.array(*(F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * F.abs(F.coalesce(num.finite(f), F.lit(0.0)))).alias("score")) for f, w in zip(features, worth, strict=True)))
    return rows.select(*key, F.explode(scores).alias("d")).select(*key, "d.*", F.lit(method).alias("method"))


def wide_predictions(detail: DataFrame, order: str) -> DataFrame:
    """(symbol, target_year, revenue and profit, predicted and actual) from one row a target; the last row of a target wins."""
    aggs = [F.max_by(F.when(F.lower("target").contains(t), F.col(c)), F.when(F.lower("target").contains(t), F.col(order))).alias(f"{t}_{short}") for t in ("revenue", "profit") for c, short in (("predicted", "pred"), ("actual", "actual"))]
    return detail.groupBy(F.upper(F.trim("symbol")).alias("symbol"), "target_year").agg(*aggs).where("revenue_pred is not null or profit_pred is not null")


def pick_year(rows: DataFrame, year: int | Column, year_col: str = "target_year", order: str = "ord") -> DataFrame:
    """A symbol's row of a year, the last of several; without one that of its latest year."""
    wanted = F.lit(year) if isinstance(year, int) else year
    rest = [c for c in rows.columns if c != "symbol"]
    key = F.struct(F.coalesce(F.col(year_col) == wanted, F.lit(False)), F.col(year_col), F.col(order))
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*rest), key).alias("row")).select("symbol", "row.*")


@dataclass
class Bundle:
    """A fitted model with what its rows must go through first."""

    model: object
    features: list[str]
    clip_bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    debt: dict[str, float] | None = None

    def prepared(self, rows: DataFrame, debt: tuple[str, str] | None = None) -> DataFrame:
        """Clipped and, for the (interest, debt) columns given, adjusted."""
        out = panel.clipped(rows, {c: b for c, b in self.clip_bounds.items() if c in rows.columns})
        return panel.debt_adjusted(out, debt[0], F.col(debt[1]), self.debt) if self.debt and debt else out

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        if isinstance(self.model, boosting.Boosted):
            self.model.save(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        about = json.dumps({"features": self.features, "clip_bounds": self.clip_bounds, "debt": self.debt, "boosted": isinstance(self.model, boosting.Boosted)})
        SparkSession.getActiveSession().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> Bundle:
        from pyspark.ml import PipelineModel
        from pyspark.sql import SparkSession

        about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about", wholetext=True).first()[0])
        model = boosting.Boosted.load(f"{path}/model") if about.get("boosted") else PipelineModel.load(f"{path}/model")
        return cls(model, about["features"], {c: tuple(b) for c, b in about["clip_bounds"].items()}, about["debt"])


#: (target, current value, whether the loss is absolute) of each model of a data set.
TARGETS = (("revenue_next", "revenue_current", False), ("profit_after_tax_next", "profit_after_tax", True))


def batch(
    datasets: dict[str, tuple[DataFrame, Sequence[str]]], train_until: int, predict: int, clip: Sequence[str] = panel.PERCENT_LIKE, recency: str = "exp", debt: dict[str, tuple[str, str]] | None = None,
    budget: dict[str, int] | None = None, mandatory: Sequence[str] = (), trees: int = 450, settings: boosting.Settings | None = None,
) -> tuple[DataFrame, dict[str, Bundle]]:
    """(dataset, target, symbol, feature_year, target_year, actual, predicted) of all data sets and targets, and their bundles.

    datasets: panels (symbol, year, values, next values) and their features.  A row's target year is the year after its
    own; rows up to ``train_until`` train, with recency weights, those of ``predict`` are scored.  debt: (interest, debt)
    columns to adjust; budget: how many features elimination leaves. settings: of regularised boosting, which then
    makes the models instead of ``regressor``.
    """
    out: DataFrame | None = None
    bundles: dict[str, Bundle] = {}
    for name, (rows, features) in datasets.items():
        rows = rows.withColumn("target_year", F.col("year") + 1)
        bundle_debt, columns = None, (debt or {}).get(name)
        if columns:
            bundle_debt = panel.debt_parameters(rows.where(F.col("target_year") <= train_until), F.col(columns[1]))
        for target, current, absolute in TARGETS:
            usable = targets(rows, current, target)
            seen = usable.where(F.col("target_year") <= train_until)
            bounds = panel.clip_bounds(seen, [c for c in clip if c in rows.columns])
            first, last = seen.agg(F.min("target_year"), F.max("target_year")).first()
            if last is None:
                continue
            bundle = Bundle(None, list(features), bounds, bundle_debt)
            train = bundle.prepared(seen, columns).withColumn("weight", panel.recency_weight(F.col("target_year"), first, last, recency))
            if budget and name in budget:
                bundle.features = eliminated(train, features, budget[name], mandatory, weight="weight", trees=min(trees, 220))
            if settings:
                bundle.model = boosting.fit(train, bundle.features, replace(settings, absolute=absolute), weight="weight")
            else:
                bundle.model = regressor(bundle.features, absolute, "weight", trees).fit(train)
            test = bundle.prepared(usable.where(F.col("target_year") == predict), columns)
            scored = predicted(bundle.model, test, current).select(F.lit(name).alias("dataset"), F.lit(target).alias("target"), F.upper("symbol").alias("symbol"), F.col("year").alias("feature_year"), "target_year", F.col(target).cast("double").alias("actual"), "predicted")
            out = scored if out is None else out.unionByName(scored)
            bundles[f"{name}_{target}"] = bundle
    if out is None:
        raise ValueError("no data set has rows to train on")
    return out.where(num.finite("actual").isNotNull() & num.finite("predicted").isNotNull()), bundles
