"""From measured parts to item reports: the whole scoring chain as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import band, confidence, interval, round4, shrink_to_half
from plumbline.operators.fusion import fuse, fused, override, weight_join
from plumbline.operators.rollup import in_distribution, item_penalties, number_parts, rollup_parts, score_parts, top_parts
from plumbline.params import BANDS, PARAMS, Params
from plumbline.plans.conclusion import conclusion

LABELS = {name: label for name, _, _, label in BANDS}


def score_items(items: DataFrame, parts: DataFrame, weights: dict[str, float], tie: tuple[str, ...] = (), detectors: dict[str, str] | None = None, p: Params = PARAMS) -> DataFrame:
    """One report row an item.

    ``items``: item_id, blur, luma, jpeg_q, marker, manifest_valid, and a score column for each detector; ``parts``: item_id, w, h, raw_score, spread, blur,
    luma, jpeg_q; ``weights``: the weight of each detector, as calibration files hold them. ``detectors``: the column of each detector's score; *spatial* stands for
    the roll-up of the parts (``part_score``), *frequency* for the column of that name, unless told otherwise. All part work is keyed by item_id: one shuffle
    of the parts serves numbering, roll-up and, with that of the items, the join; fusion is an expression on the item's row.
    """
    detectors = detectors or {"spatial": "part_score", "frequency": "frequency"}
    scored = score_parts(top_parts(number_parts(parts, *tie), p.max_parts), p)
    rolled = rollup_parts(scored, p).select("item_id", F.col("score").alias("part_score"), F.col("spread").alias("part_spread"), "n_parts", "n_elevated", "pattern", "top_h", "rollup_penalties")
    joined = items.join(rolled, "item_id", "left")
    joined = joined.withColumns({"n_parts": F.coalesce("n_parts", F.lit(0)), "n_elevated": F.coalesce("n_elevated", F.lit(0)), "pattern": F.coalesce("pattern", F.lit("none_elevated"))})
    held = item_penalties(joined, p)
    empty = F.expr("cast(array() as array<struct<reason:string,factor:double>>)")
    held = held.withColumn("rollup_penalties", F.coalesce("rollup_penalties", empty))
    held = held.withColumn("all_penalties", F.concat("penalties", "rollup_penalties")).withColumn("confidence", confidence(F.col("all_penalties")))

    # without a part nothing was analysed: no detector counts
    has = F.col("n_parts") > 0
    scores = F.array(*[F.struct(F.lit(d).alias("detector"), F.when(has, F.col(c)).alias("score"), F.lit(float(weights.get(d, 0.0))).alias("weight")) for d, c in sorted(detectors.items())])
    held = held.withColumn("_fused", fused(scores))
    held = override(held.withColumns({c: F.col(f"_fused.{c}") for c in ("score", "disagreement", "notes")}), p)
    final = score_and_spread(held, has)
    final = final.withColumn("uncertainty", interval(F.col("score"), F.col("spread"), F.col("confidence"))).withColumn("band", band(F.col("score")))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("band"))
    ok = in_distribution(F.col("penalties"), F.col("rollup_penalties"), F.col("n_parts"))
    return final.withColumn("_text", conclusion(F.col("pattern"), F.col("n_parts"), F.col("n_elevated"), label)).select(
        "item_id", "score", F.col("uncertainty.lo").alias("lo"), F.col("uncertainty.hi").alias("hi"), "band", F.round("confidence", 6).alias("confidence"), "override", "n_parts", "n_elevated", "pattern",
        F.size("all_penalties").alias("n_penalties"), ok.alias("in_distribution"), "notes", "_text.headline", "_text.detail", "_text.next_steps",
    )


def score_and_spread(held: DataFrame, has: Column) -> DataFrame:
    """Scores shrunk by confidence, and the wider of both spreads; items without parts stay where they are."""
    score = round4(F.when(has, shrink_to_half(F.col("score"), F.col("confidence"))).otherwise(F.col("score")))
    return held.withColumns({"score": score, "spread": F.when(has, F.greatest("disagreement", "part_spread")).otherwise(0.0)})


def score_items_long(items: DataFrame, scores: DataFrame, weights: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Fusion and override of items whose scores come as rows, from any detectors: ``scores(item_id, detector, score)``, items with marker and manifest_valid; items without a score are at 0.5."""
    made = fuse(weight_join(scores, weights))
    joined = items.join(made.hint("merge"), "item_id", "left")
    none = {"score": F.lit(0.5), "disagreement": F.lit(0.0), "weights_used": F.expr("cast(map() as map<string, double>)"), "notes": F.expr("array('no detector gave a score')")}
    return override(joined.withColumns({c: F.coalesce(F.col(c), x) for c, x in none.items()}), p)
