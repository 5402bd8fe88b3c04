"""Detector metrics per group: ROC, AUC with bootstrap intervals, EER, TPR at fixed FPR, calibration error.

All metrics depend on distinct scores only, so scores are first summed to *cells*: one row a (group, score) with its positives and negatives. Ranking
needs running sums over the cells of a group. No task gets a whole group: cells are dealt into ranges of the score, each ordered by itself, and the totals
of the ranges (a few thousand rows a group at most) carry the sums on. ``scores(<group...>, label, score)``: null scores are dropped.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.tables import written
from plumbline.params import PARAMS

GROUP = ["dataset", "detector"]


def drop_unscored(samples: DataFrame, detectors: list[str], keys: list[str]) -> DataFrame:
    """One row a (key, detector) that has a score."""
    return samples.unpivot(keys, detectors, "detector", "score").where(F.col("score").isNotNull())


def measurable(scores: DataFrame, group: list[str] = GROUP, least: int = PARAMS.min_samples) -> DataFrame:
    """Rows of the groups with ``least`` samples and both labels."""
    kept = scores.groupBy(*group).agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return scores.join(kept.where((F.col("n") >= least) & (F.col("low") < F.col("high"))).select(*group).hint("merge"), group, "left_semi")


def by_score(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, score, tp, fp): positives and negatives at each distinct score."""
    kept = scores.where(F.col("score").isNotNull())
    return kept.groupBy(*group, "score").agg(F.sum("label").cast("double").alias("tp"), F.sum(1 - F.col("label")).cast("double").alias("fp"))


#: Cells of a range, about; ranges of a group at most; splitters that are passed over at a time; groups whose splitters are broadcast at most (8 KB each).
RANGE_CELLS, RANGES, STRIDE, SPLITTERS = 2_048, 1_024, 32, 2_000


def with_ranges(cells: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Written ``cells(group, score, ...)`` with ``range``, a number that rises with the score: ranges of a group hold about as many cells each, wherever its scores crowd.

    A quantile sketch of each group, merged from those of all tasks, gives the splitters. They are written: the ranges are the same in whatever reads them.
    """
    sketch = F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 8 * RANGES)
    found = cells.groupBy(*group).agg(F.least(F.lit(RANGES), F.ceil(F.count("*") / RANGE_CELLS)).cast("int").alias("ranges"), sketch.alias("all"))
    some = F.when(F.col("ranges") > 1, F.transform(F.sequence(F.lit(1), F.col("ranges") - 1), lambda k: F.get("all", F.floor(k * RANGES / F.col("ranges")).cast("int") - 1)))
    splitters = found.select(*group, F.coalesce(some, F.array().cast("array<double>")).alias("splitters"))
    strides = F.transform(F.sequence(F.lit(0), F.floor(F.size("splitters") / STRIDE).cast("int")), lambda k: F.get("splitters", k * STRIDE))
    splitters = written(splitters.withColumn("strides", F.array_compact(strides)), "splitters")
    joined = cells.join(splitters.hint("broadcast" if splitters.count() <= SPLITTERS else "merge"), group)
    passed = lambda a: F.size(F.filter(a, lambda s: s < F.col("score")))
    at = F.greatest(F.lit(0), passed("strides") - 1) * STRIDE
    return joined.withColumn("range", at + passed(F.slice("splitters", at + 1, F.lit(STRIDE)))).drop("splitters", "strides")


def score_cells(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, score, tp, fp, range): the cells of ``by_score``, written, with their ranges."""
    return with_ranges(written(by_score(scores, group), "cells"), group)


def running(ranges: DataFrame, group: list[str], columns: list[str], order: Column) -> DataFrame:
    """``ranges(group, range, <columns>)`` with ``<column>_before``: the sums over the ranges before each in ``order``."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns})


def cells_auc(cells: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, auc) from cells (group, score, tp, fp, range)."""
    below = Window.partitionBy(*group, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("below", F.coalesce(F.sum("fp").over(below), F.lit(0.0)))
    ranges = ranked.groupBy(*group, "range").agg(F.sum(F.col("tp") * (F.col("below") + F.col("fp") / 2)).alias("inside"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return ranges_auc(ranges, group)


def ranges_auc(ranges: DataFrame, group: list[str]) -> DataFrame:
    """(group, auc) from the sums of ranges (group, range, inside, tp, fp), ``inside`` being the pairs in order within one."""
    pairs = F.sum("tp") * F.sum("fp")
    won = F.sum(F.col("inside") + F.col("tp") * F.col("fp_before"))
    return running(ranges, group, ["fp"], F.col("range")).groupBy(*group).agg(F.when(pairs > 0, won / pairs).alias("auc"))


def auc(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Area under the ROC curve, ties counted half; null for groups of one label."""
    return cells_auc(score_cells(scores, group), group)


def cells_roc(cells: DataFrame, group: list[str] = GROUP, drop_intermediate: bool = True) -> DataFrame:
    """``roc_curve`` from cells (group, score, tp, fp, range)."""
    key, falling = [*group, "range"], F.desc("range")
    whole, order = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(falling)
    head = F.max_by(F.struct("tp", "fp"), "score").alias("head")
    ranges = running(cells.groupBy(*key).agg(F.sum("tp").alias("tps"), F.sum("fp").alias("fps"), F.count("*").alias("rows"), head), group, ["tps", "fps"], falling)
    ranges = ranges.select(
        *key, "tps_before", "fps_before", F.sum("tps").over(whole).alias("p"), F.sum("fps").over(whole).alias("n"), F.sum("rows").over(whole).alias("all_rows"),
        F.lead("head").over(order).alias("next_head"), F.lag("range").over(order).isNull().alias("first"),
    )
    inside = Window.partitionBy(*key).orderBy(F.desc("score"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    points = cells.join(ranges.hint("shuffle_hash"), key)
    points = points.select(
        *key, "score", "p", "n", "all_rows", "tp", "fp", (F.col("tps_before") + F.sum("tp").over(so_far)).alias("tps"), (F.col("fps_before") + F.sum("fp").over(so_far)).alias("fps"),
        F.coalesce(F.lead(F.struct("tp", "fp")).over(inside), "next_head").alias("next"), (F.col("first") & F.lag("score").over(inside).isNull()).alias("opens"),
    )
    if drop_intermediate:
        bent = (F.col("next.tp") != F.col("tp")) | (F.col("next.fp") != F.col("fp"))
        points = points.where((F.col("all_rows") <= 2) | F.col("opens") | F.col("next").isNull() | bent)
    counts = running(points.groupBy(*key).agg(F.count("*").alias("kept")), group, ["kept"], falling).select(*key, "kept_before")
    numbered = points.join(counts.hint("shuffle_hash"), key).withColumn("idx", (F.col("kept_before") + F.row_number().over(inside)).cast("int"))
    kept = numbered.select(*group, "idx", (F.col("fps") / F.when(F.col("n") > 0, F.col("n"))).alias("fpr"), (F.col("tps") / F.when(F.col("p") > 0, F.col("p"))).alias("tpr"), F.col("score").alias("threshold"))
    origin = ranges.where("first").select(*group, F.lit(0).alias("idx"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return origin.unionByName(kept)


def roc_curve(scores: DataFrame, group: list[str] = GROUP, drop_intermediate: bool = True) -> DataFrame:
    """(group, idx, fpr, tpr, threshold) by falling threshold from the origin (idx 0, threshold null for infinity).

    Points on a straight line between their neighbours are dropped, unless told otherwise. Rates of an absent label are null.
    """
    return cells_roc(score_cells(scores, group), group, drop_intermediate)


def equal_error_rate(roc: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, eer, eer_threshold): the first point at which both error rates are nearest."""
    gap = F.abs(1 - F.col("tpr") - F.col("fpr"))
    point = F.struct(((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer"), "threshold")
    best = roc.where(gap.isNotNull()).groupBy(*group).agg(F.min_by(point, F.struct(F.round(gap, 12).alias("gap"), "idx")).alias("p"))
    return best.select(*group, "p.eer", F.col("p.threshold").alias("eer_threshold"))


def tpr_at_fpr(scores: DataFrame, roc: DataFrame, group: list[str] = GROUP, targets: tuple[float, ...] = PARAMS.target_fprs) -> DataFrame:
    """(group, target_fpr, tpr, threshold, measurable, unstable, reason) for each target.

    Too few negatives to resolve a target make it unmeasurable, with a reason instead of a number; fewer than ten expected false positives
    make it unstable.
    """
    sizes = scores.where(F.col("score").isNotNull()).groupBy(*group).agg(F.count_if(F.col("label") == 0).alias("n_negative"))
    best = roc.groupBy(*group).agg(*[F.max_by(F.struct("tpr", "threshold"), F.when(F.col("fpr") <= t, F.col("idx"))).alias(f"t{i}") for i, t in enumerate(targets)])
    asked = F.array(*[F.struct(F.lit(t).alias("target_fpr"), F.col(f"t{i}").alias("p")) for i, t in enumerate(targets)])
    joined = sizes.join(best.hint("merge"), group, "left").select(*group, "n_negative", F.inline(asked))
    n, t = F.col("n_negative"), F.col("target_fpr")
    reason = F.when(n == 0, "no negatives").when(t < 1 / F.greatest(n, F.lit(1)), F.format_string("not measurable: %d negatives", n))
    found = joined.withColumn("reason", reason)
    known = F.col("reason").isNull()
    return found.select(*group, "target_fpr", F.when(known, F.col("p.tpr")).alias("tpr"), F.when(known, F.col("p.threshold")).alias("threshold"), known.alias("measurable"), (known & (t * n < 10)).alias("unstable"), "reason")


def cells_bins(cells: DataFrame, group: list[str] = GROUP, bins: int = PARAMS.bins) -> DataFrame:
    """``calibration_bins`` from cells (group, score, tp, fp)."""
    n, at = F.col("tp") + F.col("fp"), F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    found = cells.groupBy(*group, at.alias("bin")).agg(F.sum(n).cast("long").alias("n"), (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_score"), (F.sum("tp") / F.sum(n)).alias("positive_share"))
    held = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "mean_score", "positive_share")))).alias("held"))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean_score"), F.lit(0.0).alias("positive_share"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("bin"), F.coalesce(F.try_element_at("held", b), empty).alias("x")))
    return held.select(*group, F.inline(rows)).select(*group, "bin", "x.n", "x.mean_score", "x.positive_share")


def calibration_bins(scores: DataFrame, group: list[str] = GROUP, bins: int = PARAMS.bins) -> DataFrame:
    """(group, bin, n, mean_score, positive_share) of equal bins, the last closed; empty bins are rows of zeros."""
    return cells_bins(by_score(scores, group), group, bins)


def calibration_error(binned: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, ece): gaps between mean score and share of positives, weighted by bin sizes."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_share"))) / F.sum("n")
    return binned.groupBy(*group).agg(gap.alias("ece"))


def cells_summary(cells: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """``class_summary`` from cells (group, score, tp, fp)."""
    mean = lambda c: F.coalesce(F.sum(F.col("score") * F.col(c)) / F.when(F.sum(c) > 0, F.sum(c)), F.lit(0.0))
    return cells.groupBy(*group).agg(
        F.sum(F.col("tp") + F.col("fp")).cast("long").alias("n"), F.sum("tp").cast("long").alias("n_positive"), F.sum("fp").cast("long").alias("n_negative"), mean("tp").alias("mean_positive"), mean("fp").alias("mean_negative")
    )


def class_summary(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, n, n_positive, n_negative, mean_positive, mean_negative); means of an absent label are 0."""
    return cells_summary(by_score(scores, group), group)


def evaluate(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """One row a group: class summary, AUC, EER with its threshold and ECE; all from the same cells."""
    cells = score_cells(scores, group)
    parts = [cells_summary(cells, group), cells_auc(cells, group), equal_error_rate(cells_roc(cells, group), group), calibration_error(cells_bins(cells, group), group)]
    return reduce(lambda a, b: a.join(b.hint("merge"), group, "left"), parts)


#: Draws that one md5 gives: eight hex digits each.
DRAWS = 4
#: Cells whose draws a task holds at a time.
STEP = 2_048


@cache
def poisson_table(k: int) -> tuple[int, np.ndarray]:
    """(lowest, cumulative probabilities from there on) of Poisson(k): what lies further than twelve deviations from k is left out."""
    reach = 12 * math.sqrt(k) + 20
    low, high = max(0, math.floor(k - reach)), math.ceil(k + reach)
    n = np.arange(low, high + 1)
    logs = low * math.log(k) - k - math.lgamma(low + 1) + np.concatenate(([0.0], np.cumsum(math.log(k) - np.log(n[1:]))))
    total = np.cumsum(np.exp(logs))
    return low, total / total[-1]


def uniform_draws(score: np.ndarray, label: int, resamples: int) -> np.ndarray:
    """Numbers in [0, 1), a row a cell and a column a replicate: from md5(number of the score|label|block), the same in any engine with md5."""
    blocks = -(-resamples // DRAWS)
    cells = np.floor(score * 2.0**52).astype(np.int64).tolist()
    digests = b"".join(hashlib.md5(f"{c}|{label}|{b}".encode()).digest() for c in cells for b in range(blocks))
    return np.frombuffer(digests, ">u4").reshape(len(cells), blocks * DRAWS)[:, :resamples] / 2.0**32


def cell_draws(score: np.ndarray, label: int, count: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(count) draws of each cell in each replicate, by inverse distribution."""
    out = np.zeros((len(count), resamples))
    some = np.flatnonzero(count)
    uniform = uniform_draws(score[some], label, resamples)
    for k in np.unique(count[some]):
        low, cumulative = poisson_table(int(k))
        rows = count[some] == k
        out[some[rows]] = low + np.searchsorted(cumulative, uniform[rows], side="right")
    return out


def range_replicates(resamples: int, width: int):
    def summed(key: tuple, cells: pa.Table) -> pa.Table:
        """One range of one group: in each replicate its weight of positives, of negatives, and of pairs inside it that are in order."""
        order = np.argsort(cells["score"].to_numpy())
        score, tp, fp = (cells[c].to_numpy()[order] for c in ("score", "tp", "fp"))
        won, positives, negatives = (np.zeros(resamples) for _ in range(3))
        for k in range(0, len(score), STEP):
            part = slice(k, k + STEP)
            p, n = cell_draws(score[part], 1, tp[part], resamples), cell_draws(score[part], 0, fp[part], resamples)
            below = negatives + np.cumsum(n, axis=0) - n
            won += (p * (below + n / 2)).sum(0)
            positives += p.sum(0)
            negatives += n.sum(0)
        own = {c: cells[c].slice(0, 1) for c in cells.column_names[:width]}
        return pa.table({**own, **{c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in (("inside", won), ("tp", positives), ("fp", negatives))}})

    return summed


def bootstrap_auc(scores: DataFrame, group: list[str] = GROUP, resamples: int = PARAMS.resamples) -> DataFrame:
    """(group, low, high, replicates): 2.5 and 97.5 percentiles of the AUC over Poisson resamples; replicates of one label are skipped.

    Rows of one score and label weigh the same in an AUC, and the sum of k draws of Poisson(1) is one of Poisson(k): each replicate draws once a cell and label, so that the
    cost follows distinct scores, not rows. All replicates of a range of scores are drawn in one task; the totals of the ranges carry the sums on. Equal scores of different groups share their draws.
    """
    cells = score_cells(scores, group)
    kind = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in group), "range int", *(f"{c} array<double>" for c in ("inside", "tp", "fp"))])
    drawn = cells.select(*group, "range", "score", "tp", "fp").groupBy(*group, "range").applyInArrow(range_replicates(resamples, len(group) + 1), kind)
    flat = drawn.select(*group, "range", F.posexplode(F.arrays_zip("inside", "tp", "fp")).alias("replicate", "x")).select(*group, "range", "replicate", "x.*")
    each = ranges_auc(flat, [*group, "replicate"]).where(F.col("auc").isNotNull())
    return each.groupBy(*group).agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))
