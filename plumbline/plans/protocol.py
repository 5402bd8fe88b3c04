"""Cross-dataset protocol: fit on one dataset, report on another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import written
from plumbline.operators.calibrate import before_after, calibrated, derive_weights, fit_temperature, split_guard
from plumbline.operators.metrics import auc, bootstrap_auc, drop_unscored, evaluate, measurable, roc_curve, tpr_at_fpr
from plumbline.params import PARAMS, Params
from plumbline.sources import reports

KEYS = ["dataset", "detector"]


def cross_dataset(samples: DataFrame, detectors: list[str], calibration: str, reporting: str, sweep: DataFrame | None = None, registry: DataFrame | None = None, p: Params = PARAMS) -> dict[str, DataFrame]:
    """Frames of the protocol over ``samples(key, dataset, label, <detectors>)``.

    in_dataset, weights, temperatures, cross (raw and calibrated side by side), thresholds and intervals of the reporting set, gap, and, where given,
    robustness of ``sweep(key, variant, label, <detectors>)`` and coverage of ``registry(dataset, ...)``. Scored rows are written once and serve all of them.
    """
    split_guard(calibration, reporting)
    # scores are written before they are read twice: they may cost much, and the rows are narrow
    long = written(measurable(written(drop_unscored(samples, detectors, ["key", "dataset", "label"]), "scores")), "scored")
    fit, report = long.where(F.col("dataset") == calibration), long.where(F.col("dataset") == reporting)
    temperatures = written(fit_temperature(fit).drop("dataset"), "temperatures")
    within, raw = written(evaluate(fit), "in-dataset"), written(evaluate(report), "raw")
    frames = {
        "in_dataset": within, "weights": derive_weights(within.select("detector", "auc")), "temperatures": temperatures,
        "cross": before_after(raw, evaluate(calibrated(report, temperatures))), "thresholds": tpr_at_fpr(report, roc_curve(report), targets=p.target_fprs),
        "intervals": bootstrap_auc(report, resamples=p.resamples), "gap": reports.generalisation_gap(within, raw),
    }
    if sweep is not None:
        frames["robustness"] = auc(measurable(written(drop_unscored(sweep, detectors, ["key", "variant", "label"]), "sweep"), ["variant", "detector"]), ["variant", "detector"])
    if registry is not None:
        frames["coverage"] = reports.coverage(samples, registry.where(F.col("dataset").isin(calibration, reporting)))
    return frames


def report_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """The report of the protocol as rows (``reports.ROWS``)."""

    def tidy(frame: DataFrame, section: str, metrics: list[str], dataset: str | None = "dataset", detector: str | None = "detector", note: str | None = None) -> DataFrame:
        given = lambda c: F.col(c) if c else F.lit(None).cast("string")
        wide = frame.select(given(dataset).alias("dataset"), given(detector).alias("detector"), given(note).alias("note"), *[F.col(m).cast("double") for m in metrics])
        return wide.unpivot(["dataset", "detector", "note"], metrics, "metric", "value").select(F.lit(section).alias("section"), "dataset", "detector", "metric", "value", "note")

    names = ["n", "n_positive", "n_negative", "mean_positive", "mean_negative", "auc", "eer", "eer_threshold", "ece"]
    cut = frames["thresholds"].withColumn("note", F.coalesce("reason", F.when(F.col("unstable"), F.lit("unstable"))))
    cut = cut.select("dataset", "detector", F.concat(F.lit("tpr at "), F.col("target_fpr").cast("string")).alias("metric"), F.col("tpr").alias("value"), "note")
    parts = [
        tidy(frames["in_dataset"], "in_dataset", names),
        tidy(frames["cross"], "cross_dataset", [f"{m}_{tail}" for m in names for tail in ("raw", "calibrated")]),
        cut.select(F.lit("thresholds").alias("section"), "dataset", "detector", "metric", "value", "note"),
        tidy(frames["intervals"], "intervals", ["low", "high", "replicates"]),
        tidy(frames["temperatures"], "temperature", ["temperature", "nll"], dataset=None),
        tidy(frames["weights"], "weights", ["auc", "weight"], dataset=None, note="rationale"),
        tidy(frames["gap"], "gap", ["auc_gap", "eer_gap"], dataset=None),
    ]
    if "robustness" in frames:
        parts.append(tidy(frames["robustness"], "robustness", ["auc"], dataset="variant"))
    if "coverage" in frames:
        parts.append(tidy(frames["coverage"], "coverage", ["n_scored", "n_without_part"], detector=None, note="licence" if "licence" in frames["coverage"].columns else None))
    return reduce(DataFrame.unionByName, parts)
