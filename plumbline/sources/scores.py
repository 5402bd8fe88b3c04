"""Score caches and calibration files: tolerant reads, resumed appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.sampling import latest_by_key, resume
from plumbline.params import SAMPLE_SCHEMA

REQUIRED = ["key", "label", "spatial", "frequency", "provenance_fired", "faces_found", "dataset"]


def parse_scores(lines: DataFrame, seq: str | None = None) -> DataFrame:
    """Samples from JSON lines (value): corrupt lines and lines without a required key go; of one key the line with the highest ``seq`` stays."""
    kept = lines.where(F.size(F.array_intersect(F.json_object_keys("value"), F.array(*[F.lit(k) for k in REQUIRED]))) == len(REQUIRED))
    read = kept.withColumn("r", F.from_json("value", SAMPLE_SCHEMA)).select("r.*", *([seq] if seq else [])).where(F.col("key").isNotNull())
    return latest_by_key(read, "key", seq) if seq else read


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Samples of text files of JSON lines; files that repeat a key win by name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_scores(lines, "file").drop("file")


def resume_append(planned: DataFrame, cached: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, key: str = "key") -> int:
    """Scores the planned rows that the cache lacks and appends them; returns how many were reused. Run again, it appends nothing."""
    todo, reused = resume(planned, cached, key)
    n = reused.count()
    score(todo).write.mode("append").parquet(path)
    return n


def write_partitioned(scores: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "n", "seed", "variant")) -> None:
    """Scores by configuration, so that reads of one prune the others."""
    scores.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)


MAPS = {"temperature": "temperature", "stream_weights": "weight", "stream_validation_auc": "auc"}


def parse_calibration(lines: DataFrame) -> DataFrame:
    """(detector, temperature, weight, auc, rationale) from calibration JSON (value); null, broken or missing parts give no rows, other than numbers are null."""
    fields = [*MAPS, "stream_weight_rationale"]
    read = lines.select(F.from_json("value", ", ".join(f"{f} map<string,string>" for f in fields)).alias("r")).select([F.coalesce(F.col(f"r.{f}"), F.expr("cast(map() as map<string,string>)")).alias(f) for f in fields])
    names = F.array_distinct(F.flatten(F.array(*[F.map_keys(f) for f in MAPS])))
    rows = read.select("*", F.explode(names).alias("detector"))
    numbers = [F.expr(f"try_cast(try_element_at({f}, detector) as double)").alias(name) for f, name in MAPS.items()]
    kept = rows.select("detector", *numbers, F.try_element_at("stream_weight_rationale", "detector").alias("rationale"))
    return kept.where("temperature is not null or weight is not null or auc is not null")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """The calibration at a path; a missing one is empty."""
    try:
        lines = spark.read.text(path, wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        lines = spark.createDataFrame([], "value string")
    return parse_calibration(lines)


def calibration_json(parameters: DataFrame, provenance: dict[str, str] | None = None) -> DataFrame:
    """One row (value): the calibration JSON of (detector, temperature, weight, auc, rationale), with where the values come from."""
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("detector", c)))))
    origin = F.create_map(*[F.lit(x) for pair in (provenance or {}).items() for x in pair]) if provenance else F.expr("cast(map() as map<string,string>)")
    maps = [pairs(c).alias(f) for f, c in MAPS.items()] + [pairs("rationale").alias("stream_weight_rationale")]
    return parameters.agg(*maps).select(F.to_json(F.struct(origin.alias("provenance"), *MAPS, "stream_weight_rationale")).alias("value"))


def write_calibration(parameters: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """The calibration file that ``read_calibration`` reads back; a former one is replaced."""
    calibration_json(parameters, provenance).coalesce(1).write.mode("overwrite").text(path)
