"""Parts of items: numbering, penalties, per-part scores and the roll-up to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import confidence, interval, round4, shrink_to_half, softmax
from plumbline.params import PARAMS, Params


def number_parts(parts: DataFrame, *tie: str) -> DataFrame:
    """``part_index`` from 1 within an item, largest area first."""
    order = Window.partitionBy("item_id").orderBy((F.col("w").cast("long") * F.col("h")).desc(), *tie)
    return parts.withColumn("part_index", F.row_number().over(order))


def top_parts(parts: DataFrame, limit: int = PARAMS.max_parts) -> DataFrame:
    """The first ``limit`` parts of each item; a limit is what this operator is for."""
    return parts.where(F.col("part_index") <= limit)


def rank_by_score(parts: DataFrame) -> DataFrame:
    """``display_rank``: score descending, ties in part order."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "part_index")
    return parts.withColumn("display_rank", F.row_number().over(order))


def clamp_boxes(boxes: DataFrame) -> DataFrame:
    """Detections (x, y, w, h double) rounded and clamped to the image (width, height); empty ones go."""
    x, y = (F.greatest(F.lit(0), F.bround(F.col(c)).cast("int")) for c in "xy")
    made = boxes.withColumns({"_x": x, "_y": y, "_w": F.bround("w").cast("int"), "_h": F.bround("h").cast("int")})
    made = made.withColumns({"_w": F.least("_w", F.col("width") - F.col("_x")), "_h": F.least("_h", F.col("height") - F.col("_y"))})
    kept = made.where((F.col("_w") > 0) & (F.col("_h") > 0))
    return kept.withColumns({c: F.col(f"_{c}") for c in "xywh"}).drop("_x", "_y", "_w", "_h")


def margin_boxes(boxes: DataFrame, margin: float = 0.25) -> DataFrame:
    """Corners x0, y0, x1, y1 of boxes widened by ``margin`` of their size and clipped to the image."""
    mx, my = (F.col("w") * margin).cast("int"), (F.col("h") * margin).cast("int")
    low = lambda a, m: F.greatest(F.lit(0), F.col(a) - m)
    high = lambda a, size, m, limit: F.least(F.col(limit), F.col(a) + F.col(size) + m)
    return boxes.withColumns({"x0": low("x", mx), "y0": low("y", my), "x1": high("x", "w", mx, "width"), "y1": high("y", "h", my, "height")})


def penalty(condition: Column, reason: Column, factor: Column | float) -> Column:
    factor = F.lit(factor) if isinstance(factor, float) else factor
    return F.when(condition, F.struct(reason.alias("reason"), factor.alias("factor")))


def shared_penalties(p: Params) -> list[Column]:
    """Blur, exposure and compression, alike for parts and items; unknown measurements give none."""
    return [
        penalty(F.col("blur") < p.min_blur, F.format_string("blurred (%.1f)", "blur"), p.blur_factor),
        penalty((F.col("luma") < p.min_luma) | (F.col("luma") > p.max_luma), F.format_string("poorly exposed (%.1f)", "luma"), p.luma_factor),
        penalty(F.col("jpeg_q") < p.min_quality, F.format_string("heavily compressed (%d)", "jpeg_q"), p.quality_factor),
    ]


def part_penalties(parts: DataFrame, p: Params = PARAMS) -> DataFrame:
    """``penalties`` of each part from its own measurements w, h, blur, luma, jpeg_q."""
    severity = F.round(F.greatest(F.lit(p.min_height_factor), F.col("h") / p.min_height), 3)
    small = penalty(F.col("h") < p.min_height, F.format_string("only %dx%d", "w", "h"), severity)
    return parts.withColumn("penalties", F.array_compact(F.array(small, *shared_penalties(p))))


def item_penalties(items: DataFrame, p: Params = PARAMS) -> DataFrame:
    """``penalties`` and descriptive ``factors`` of each item from top_h, blur, luma, jpeg_q; top_h is null without parts.

    Every item carries the penalty of uncalibrated scores; items without parts one more.
    """
    small = penalty(F.col("top_h") < p.min_height, F.format_string("largest part %d high", "top_h"), p.item_height_factor)
    raw = penalty(F.lit(True), F.lit("uncalibrated"), p.uncalibrated_factor)
    none = penalty(F.col("top_h").isNull(), F.lit("no part"), p.no_part_factor)
    factors = F.struct(
        F.coalesce(F.format_string("%d", "top_h"), F.lit("no part")).alias("part_size"),
        F.format_string("variance %.1f", "blur").alias("blur"),
        F.format_string("mean %.1f", "luma").alias("illumination"),
        F.coalesce(F.format_string("quality %d", "jpeg_q"), F.lit("unknown")).alias("compression"),
    )
    return items.withColumns({"penalties": F.array_compact(F.array(small, *shared_penalties(p), raw, none)), "factors": factors})


def penalty_rows(frame: DataFrame, *keys: str) -> DataFrame:
    """One row a penalty: keys, position from 0, reason, factor."""
    return frame.select(*keys, F.posexplode("penalties").alias("pos", "p")).select(*keys, "pos", "p.reason", "p.factor")


def confidence_of_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Confidence from penalty rows: the product of all factors."""
    return rows.groupBy(*keys).agg(F.product("factor").alias("confidence"))


def score_parts(parts: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Parts with penalties, confidence, adjusted ``score`` (four places) and its interval."""
    held = part_penalties(parts, p).withColumn("confidence", confidence(F.col("penalties")))
    held = held.withColumn("score", round4(shrink_to_half(F.col("raw_score"), F.col("confidence"))))
    return held.withColumn("uncertainty", interval(F.col("score"), F.col("spread"), F.col("confidence")))


def align_parts(faces: DataFrame, scores: DataFrame) -> DataFrame:
    """Strict one-to-one join on (item_id, part_index); a part on one side only is an error."""
    keys = ["item_id", "part_index"]
    both = faces.withColumn("_l", F.lit(True)).join(scores.withColumn("_r", F.lit(True)), keys, "full_outer")
    whole = F.coalesce(F.col("_l") & F.col("_r"), F.lit(False))
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("parts and scores differ")).cast("boolean"))).drop("_l", "_r")


def multiplicity_factor(n: Column, p: Params = PARAMS) -> Column:
    return F.greatest(F.lit(p.multiplicity_floor), 1 / (1 + p.multiplicity_step * (n - 1)))


def rollup_parts(parts: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Per item: the largest score, the spread of the first part that has it, counts, pattern and roll-up penalties."""
    first = F.max_by("spread", F.struct(F.col("score"), (-F.col("part_index")).alias("i")))
    sums = parts.groupBy("item_id").agg(
        F.max("score").alias("score"), first.alias("spread"), F.count("*").alias("n_parts"), F.count_if(F.col("score") >= p.elevated).alias("n_elevated"), F.max_by("h", -F.col("part_index")).alias("top_h")
    )
    n, k = F.col("n_parts"), F.col("n_elevated")
    pattern = F.when(n == 1, "single_part").when(k == 0, "none_elevated").when((k == n) & (n >= p.global_cause_parts), "all_elevated").when(k == 1, "single_outlier").otherwise("several_elevated")
    sums = sums.withColumn("pattern", pattern)
    alike = penalty(F.col("pattern") == "all_elevated", F.format_string("all %d parts alike", n), p.global_cause_factor)
    alone = penalty(F.col("pattern") == "single_outlier", F.format_string("one part of %d stands out", n), F.round(multiplicity_factor(n, p), 3))
    return sums.withColumn("rollup_penalties", F.array_compact(F.array(alike, alone)))


def naive_max(parts: DataFrame) -> DataFrame:
    """Largest part score of an item and its spread; the roll-up without correction."""
    return parts.groupBy("item_id").agg(F.max("score").alias("score"), F.max_by("spread", F.struct(F.col("score"), (-F.col("part_index")).alias("i"))).alias("spread"))


def top3_max(items: DataFrame, parts: DataFrame, limit: int = PARAMS.eval_parts) -> DataFrame:
    """Evaluation score of each item: the largest of its first three parts by area, null without parts."""
    best = top_parts(parts, limit).groupBy("item_id").agg(F.max("raw_score").alias("score"))
    return items.select("item_id").join(best, "item_id", "left")


def pool_variants(logits: DataFrame, positive: int = 1) -> DataFrame:
    """Test-time variants (item_id, variant, logits): probability of the mean logits, and spread of the variants' own probabilities."""
    made = logits.withColumn("p", F.get(softmax(F.col("logits")), F.lit(positive)))
    kinds = made.select("item_id", "variant", "p", F.posexplode("logits").alias("class", "z"))
    means = kinds.groupBy("item_id", "class").agg(F.avg("z").alias("z")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("class", "z"))).alias("zs"))
    pooled = means.select("item_id", F.get(softmax(F.transform("zs", lambda s: s["z"])), F.lit(positive)).alias("score"))
    spreads = made.groupBy("item_id").agg(F.stddev_pop("p").alias("spread"), F.count("*").alias("n_variants"))
    return pooled.join(spreads.hint("merge"), "item_id")  # rows of an explosion have no true size


def in_distribution(penalties: Column, rollup_penalties: Column, n_parts: Column) -> Column:
    return (F.size(penalties) <= 1) & (F.size(rollup_penalties) == 0) & (n_parts > 0)
