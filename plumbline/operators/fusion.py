"""Fusion of detectors' scores and provenance facts into one score an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip, places3
from plumbline.functions.tables import small
from plumbline.params import PARAMS, Params


def weight_join(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """``weight`` of each detector, 0 for unknown ones; ``weights`` has one row a detector."""
    return scores.join(small(weights.select("detector", "weight")), "detector", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def fused(scores: Column) -> Column:
    """Struct (score, disagreement, weights_used, notes) from an item's array of structs (detector, score, weight); null scores are unavailable.

    Weighted mean over the available detectors and the population deviation of those with weight. Without any weight the detector with the highest
    score counts alone (the first by name among equals); without any score the item is at 0.5.
    """
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, s: a + f(s))
    available = F.filter(scores, lambda s: s["score"].isNotNull())
    weighted = F.filter(available, lambda s: s["weight"] > 0)
    total = add(weighted, lambda s: s["weight"])
    none, alone = F.size(available) == 0, F.size(weighted) == 0
    first = F.array_min(F.transform(available, lambda s: F.struct((-s["score"]).alias("score"), s["detector"].alias("detector"))))
    mean = add(weighted, lambda s: s["score"]) / F.size(weighted)
    spread = F.when(F.size(weighted) > 1, F.sqrt(add(weighted, lambda s: (s["score"] - mean) * (s["score"] - mean)) / F.size(weighted))).otherwise(0.0)
    score = F.when(none, 0.5).when(alone, -first["score"]).otherwise(add(weighted, lambda s: s["score"] * s["weight"]) / total)
    empty = F.expr("cast(map() as map<string, double>)")
    used = F.when(none, empty).when(alone, F.create_map(first["detector"], F.lit(1.0))).otherwise(F.map_from_entries(F.transform(weighted, lambda s: F.struct(s["detector"], s["weight"] / total))))
    note = (
        F.when(none, "no detector gave a score")
        .when(alone, F.concat(F.lit("no weights are known for these detectors: the score is that of "), first["detector"]))
        .when(F.size(weighted) > 1, F.concat(F.lit("weighted by validation AUC; the detectors lie "), places3(spread), F.lit(" apart")))
    )
    return F.struct(score.alias("score"), spread.alias("disagreement"), used.alias("weights_used"), F.array_compact(F.array(note)).alias("notes"))


def fuse(scores: DataFrame) -> DataFrame:
    """(item_id, score, disagreement, weights_used, notes) per item of ``scores(item_id, detector, score, weight)``, by the rule of ``fused``; an item has one row a detector."""
    rows = scores.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("detector", "score", "weight"))).alias("s"))
    return rows.select("item_id", fused(F.col("s")).alias("f")).select("item_id", "f.*")


def override(rows: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Floors the score where ``marker`` names a generator; only without one, clamps it where ``manifest_valid`` is true.

    ``override`` tells which rule changed the score, null for none. Unknown facts (null) change nothing. Where rows have ``notes``, a change adds one, with the
    ``signer`` if they have that.
    """
    marked = F.col("marker").isNotNull() & (F.col("marker") != "")
    floor = marked & (F.col("score") < p.marker_floor)
    clamp = ~marked & F.coalesce("manifest_valid", F.lit(False)) & (F.col("score") > p.manifest_clamp)
    rule = F.when(floor, "generator_metadata").when(clamp, "c2pa_valid")
    score = clip(F.when(floor, p.marker_floor).when(clamp, p.manifest_clamp).otherwise(F.col("score")))
    changed = {"override": rule, "score": score}
    if "notes" in rows.columns:
        signer = F.coalesce("signer", F.lit("an unnamed signer")) if "signer" in rows.columns else F.lit("an unnamed signer")
        raised = F.concat(F.lit("metadata names "), F.col("marker"), F.lit(f": raised to {p.marker_floor}; markers can be removed, so none proves nothing"))
        lowered = F.concat(F.lit("valid credentials of "), signer, F.lit(f": lowered to {p.manifest_clamp}; they attest the signing, not what came before"))
        changed["notes"] = F.array_compact(F.concat(F.coalesce("notes", F.expr("cast(array() as array<string>)")), F.array(F.when(floor, raised).when(clamp, lowered))))
    return rows.withColumns(changed)


def component_score(tail: Column, noise: Column, grid: Column, p: Params = PARAMS) -> Column:
    """Mean of the three signal statistics, each up to its reference level."""
    return clip((F.least(F.lit(1.0), tail / p.tail_reference) + F.least(F.lit(1.0), noise / p.noise_reference) + F.least(F.lit(1.0), grid / p.grid_reference)) / 3)


def signal_notes(tail: Column, noise: Column, grid: Column, p: Params = PARAMS) -> Column:
    """A note for each statistic above its reference, else one that there is none."""
    found = F.array_compact(F.array(
        F.when(tail > p.tail_reference, F.format_string("irregular spectrum tail (%.2f)", tail)),
        F.when(noise > p.noise_reference, F.format_string("uneven noise (%.2f)", noise)),
        F.when(grid > p.grid_reference, F.format_string("pronounced block grid (%.2f)", grid)),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("nothing unusual measured"))).otherwise(found)


def fold_notes(notes: DataFrame, *keys: str) -> DataFrame:
    """``notes`` of each key in order of ``pos`` from rows (keys, pos, note)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "note")))
    return notes.groupBy(*keys).agg(F.transform(ordered, lambda n: n["note"]).alias("notes"))


def provenance_fired(present: Column, marker: Column, exif_consistent: Column) -> Column:
    """Whether any provenance fact was found; an unknown consistency is no contradiction."""
    return F.coalesce(present, F.lit(False)) | marker.isNotNull() | F.coalesce(~exif_consistent, F.lit(False))
