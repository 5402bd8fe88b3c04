"""Sampling plans, manifests and score caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbering import numbered
from plumbline.params import SUFFIXES


def labelled_members(members: DataFrame, segment: int, labels: dict[str, int], fixed: int | None = None) -> DataFrame:
    """``members(archive, path)`` that are media, with ``label``: a fixed one, or that of a path segment (from 0); unknown ones go."""
    media = members.where(F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in SUFFIXES) + ")$"))
    if fixed is not None:
        return media.withColumn("label", F.lit(fixed))
    known = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return media.withColumn("label", F.try_element_at(known, F.lower(F.get(F.split("path", "/"), F.lit(segment))))).where(F.col("label").isNotNull())


def dataset_registry(specs: DataFrame) -> DataFrame:
    """One row a source of ``specs(dataset, hub_id, licence, commercial, sources)``: dataset, licence, commercial, path, and label or label_segment with label_names."""
    return specs.select("dataset", "hub_id", "licence", "commercial", F.inline("sources"))


def balanced_sample(samples: DataFrame, limit: int, seed: int, key: str = "key", group: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit // 2`` of each label (and group) in an order drawn by md5 of seed and key; a label with most of the rows is numbered by ranges, like all."""
    drawn = samples.withColumn("_drawn", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    return numbered(drawn, [*group, "label"], ["_drawn", key]).where(F.col("_n") < limit // 2).drop("_drawn", "_n", "_all")


def latest_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the highest ``seq``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("r")).select(key, "r.*")


def resume(planned: DataFrame, cached: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows still to score, cached scores of planned keys)."""
    return planned.join(cached, key, "left_anti"), cached.join(planned.select(key).distinct(), key, "left_semi")


def systematic_cap(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """Every step-th row of each group, at most ``cap``: the step that spreads them over the group. No task gets a group: rows are numbered by ranges."""
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / cap))
    return numbered(rows, [group], [order]).where((F.col("_n") % step == 0) & (F.floor(F.col("_n") / step) < cap)).drop("_n", "_all")


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out
