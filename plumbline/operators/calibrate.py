"""Calibration: temperature by grid search, fusion weights from measured AUC, and their use on other data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import apply_temperature, clip, places3
from plumbline.functions.tables import small
from plumbline.operators.metrics import GROUP, by_score
from plumbline.params import PARAMS, TEMPERATURES, Params


def temperature_losses(scores: DataFrame, group: list[str] = GROUP, grid: list[float] = TEMPERATURES, p: Params = PARAMS) -> DataFrame:
    """(group, temperature, nll): mean clipped negative log likelihood at each temperature, over distinct scores."""
    cells = by_score(scores, group).withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in grid])))
    q = clip(apply_temperature(F.col("score"), F.col("temperature")), p.nll_eps, 1 - p.nll_eps)
    loss = -(F.col("tp") * F.log(q) + F.col("fp") * F.log(1 - q))
    return cells.groupBy(*group, "temperature").agg((F.sum(loss) / F.sum(F.col("tp") + F.col("fp"))).alias("nll"))


def fit_temperature(scores: DataFrame, group: list[str] = GROUP, grid: list[float] = TEMPERATURES) -> DataFrame:
    """(group, temperature, nll): the temperature of least loss, the smallest among equals (to ten places)."""
    losses = temperature_losses(scores, group, grid)
    best = F.min(F.struct(F.round("nll", 10).alias("nll"), "temperature"))
    return losses.groupBy(*group).agg(best.alias("b")).select(*group, "b.temperature", "b.nll")


def derive_weights(aucs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``aucs(<group>, detector, auc)`` with ``weight`` and ``rationale``: lift over chance, normalised over the detectors of a group.

    Detectors below chance get 0 and are not inverted; if none is above it, all get 0. ``aucs`` has one row a detector.
    """
    lift = F.greatest(F.lit(0.0), F.col("auc") - 0.5)
    total = F.sum(lift).over(Window.partitionBy(*(group or [F.lit(0)])))
    weight = F.when(total > 0, lift / total).otherwise(0.0)
    measured = places3(F.col("auc"))
    why = F.when(total <= 0, "weights need a detector above chance, and there is none").when(lift == 0, F.concat(F.lit("left out: measured AUC "), measured, F.lit(", chance is 0.5"))).otherwise(F.concat(F.lit("its share of all lift over chance; measured AUC "), measured))
    return aucs.select(*(group or []), "detector", F.round("auc", 4).alias("auc"), F.round(weight, 4).alias("weight"), why.alias("rationale"))


def ordered_weights(weights: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Weights with ``rank``, their place in reports: by AUC, highest first, equal ones by name; in that order. A group has a row a detector."""
    order = Window.partitionBy(*(group or [])).orderBy(F.desc_nulls_last("auc"), "detector")
    return weights.withColumn("rank", F.row_number().over(order)).orderBy(*(group or []), "rank")


def calibrated(scores: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Scores at the temperature that other data gave their detector; detectors without one stay as they are. ``temperatures``: one row a detector, written or literal."""
    joined = scores.join(small(temperatures.select("detector", "temperature")), "detector", "left")
    return joined.withColumn("score", F.when(F.col("temperature").isNull(), F.col("score")).otherwise(apply_temperature(F.col("score"), F.col("temperature")))).drop("temperature")


def before_after(raw: DataFrame, after: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Metrics of two runs side by side: each other column as ``<name>_raw`` and ``<name>_calibrated``."""
    named = lambda f, tail: f.select(*keys, *[F.col(c).alias(f"{c}_{tail}") for c in f.columns if c not in keys])
    return named(raw, "raw").join(named(after, "calibrated").hint("merge"), keys)


def split_guard(calibration: str, reporting: str) -> None:
    """A dataset must not be calibrated and reported on."""
    if calibration == reporting:
        raise ValueError("calibration and reporting datasets must differ")


def overlap_guard(one: DataFrame, other: DataFrame, key: str = "key") -> DataFrame:
    """``one``, or an error at its first key that ``other`` has too."""
    joined = one.join(other.select(key, F.lit(True).alias("_seen")).distinct().hint("merge"), key, "left")
    return joined.where(F.when(F.col("_seen").isNull(), True).otherwise(F.raise_error(F.lit("a key is in both splits")).cast("boolean"))).drop("_seen")
