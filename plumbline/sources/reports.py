"""Reports as nested JSON columns, files and flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import fixed, percent


def report_column(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, report): the other columns as one JSON document."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("report"))


def read_report_column(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("report", F.from_json("report", schema))


#: A report is tidy rows: what was measured where, as a number or a text.
ROWS = "section string, dataset string, detector string, metric string, value double, note string"


def nested(rows: DataFrame) -> DataFrame:
    """One row (value): the report (ROWS) as nested JSON, section by section, dataset by dataset, detector by detector; a metric is its number, or its note where it has none.

    Rows of a report are bounded by datasets, detectors and metrics, whatever they were measured on.
    """
    text = F.when(F.col("value").isNotNull(), F.to_json(F.struct(F.col("value").alias("v"), F.col("note").alias("n")))).otherwise(F.to_json(F.struct(F.col("note").alias("n"))))
    level = rows.select("section", F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce("detector", F.lit("")).alias("detector"), F.col("metric").alias("name"), text.alias("json"))
    pair = lambda s: F.concat(F.regexp_replace(F.to_json(F.array(s["name"])), r"^\[|\]$", ""), F.lit(":"), s["json"])
    for keys in (["section", "dataset", "detector"], ["section", "dataset"], ["section"], []):
        members = F.transform(F.array_sort(F.collect_list(F.struct("name", "json"))), pair)
        made = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
        level = level.groupBy(*keys).agg(made.alias("json")) if keys else level.agg(made.alias("json"))
        if keys:
            level = level.select(*keys[:-1], F.col(keys[-1]).alias("name"), "json")
    return level.select(F.col("json").alias("value"))


def read_nested(lines: DataFrame) -> DataFrame:
    """ROWS again from nested reports (value)."""
    kind = "map<string,map<string,map<string,map<string,struct<v:double,n:string>>>>>"
    read = lines.select(F.explode(F.from_json("value", kind)).alias("section", "x"))
    for name in ("dataset", "detector", "metric"):
        read = read.select(*[c for c in read.columns if c != "x"], F.explode("x").alias(name, "y")).withColumnRenamed("y", "x")
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return read.select("section", blank("dataset"), blank("detector"), "metric", F.col("x.v").alias("value"), F.col("x.n").alias("note"))


def write_report(rows: DataFrame, path: str, date: str) -> None:
    """The nested report (ROWS) of a date as one JSON line; a former one of that date is replaced."""
    nested(rows).coalesce(1).write.mode("overwrite").text(f"{path}/date={date}")


def latest_report(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of the file that is last by name below a path; an empty table where there is none."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return files.agg(F.max_by("value", "file").alias("value"), F.max("file").alias("file")).where(F.col("file").isNotNull())


def report_table(rows: DataFrame) -> DataFrame:
    """Flat text rows (section, detector, metric, value, note) of a report (ROWS); what has no number shows that, with its reason."""
    named = F.concat_ws(" ", "section", "dataset").alias("section")
    return rows.select(named, F.coalesce("detector", F.lit("")).alias("detector"), "metric", fixed(F.col("value")).alias("value"), F.coalesce("note", F.lit("")).alias("note"))


def distinct_detectors(rows: DataFrame) -> DataFrame:
    """(detector) of all detectors that a table with such a column names."""
    return rows.select("detector").where(F.col("detector").isNotNull()).distinct()


def coverage(samples: DataFrame, registry: DataFrame, seconds: str | None = None) -> DataFrame:
    """Registry rows (dataset, ...) with how many samples were scored, how many had no part and, where ``seconds`` names a column, how long they took."""
    took = [F.round(F.sum(seconds), 1).alias("seconds")] if seconds else []
    counts = samples.groupBy("dataset").agg(F.count("*").alias("n_scored"), F.count_if(F.col("spatial").isNull()).alias("n_without_part"), *took)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return registry.join(counts.hint("merge"), "dataset", "left").select(*registry.columns, *[zero(c) for c in ("n_scored", "n_without_part", *(["seconds"] if seconds else []))])


def fired_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("dataset").agg(F.count_if("fired").alias("n_fired"), F.count("*").alias("n"))


def robustness(aucs: DataFrame, detectors: list[str]) -> DataFrame:
    """AUC of each variant by detector, rounded to four places, one column a detector; numeric variants from the highest."""
    wide = aucs.groupBy("variant").pivot("detector", detectors).agg(F.round(F.first("auc"), 4))
    return wide.orderBy(F.expr("try_cast(variant as double)").desc_nulls_last(), "variant")


def generalisation_gap(in_dataset: DataFrame, cross: DataFrame) -> DataFrame:
    """(detector, auc_in, auc_cross, auc_gap, eer_in, eer_cross, eer_gap) from two evaluations."""
    named = lambda f, tail: f.select("detector", *[F.col(c).alias(f"{c}_{tail}") for c in ("auc", "eer")])
    both = named(in_dataset, "in").join(named(cross, "cross").hint("merge"), "detector")
    return both.withColumns({f"{c}_gap": F.col(f"{c}_in") - F.col(f"{c}_cross") for c in ("auc", "eer")})
