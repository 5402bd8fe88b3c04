"""The stream of fingerprints equals its SQL over folders that name columns, and over embeddings with missing values."""

import duckdb
import pytest
from plumbline.fixtures import fingerprints_of
from plumbline.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAN = float("nan")
VALUES = [(i * 37 % 64) / 8 for i in range(64)]
EMBEDDINGS = [
    VALUES, VALUES, VALUES[::-1], [None, *VALUES[1:]], [*VALUES[:63], None], [None if i % 2 else v for i, v in enumerate(VALUES)], [NAN if i % 3 else v for i, v in enumerate(VALUES)],
    VALUES[:63], VALUES[:40], VALUES[:20], [None] * 64, None,
]


def from_sql(query, embeddings):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{embeddings}')")
    return sorted((tuple(r) for r in con.sql(ORACLE[query]).fetchall()), key=str)


@pytest.mark.parametrize("query", ["repeat_uploads", "fingerprint_hex"])
def test_missing_values_are_not_above_the_median(spark, tmp_path, query):
    spark.createDataFrame(list(enumerate(EMBEDDINGS)), "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((tuple(r) for r in QUERIES[query](spark, str(tmp_path)).collect()), key=str)
    assert found == from_sql(query, f"{tmp_path}/embeddings.parquet/*.parquet")


def test_streams_read_folders_that_name_columns(spark, tmp_path):
    named = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("part", F.col("vec_id") % 3)
    named.write.partitionBy("part").parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((tuple(r) for r in QUERIES["repeat_uploads"](spark, str(tmp_path)).collect()), key=str)
    assert found == from_sql("repeat_uploads", f"{SF}/embeddings.parquet")


def test_more_than_64_values_are_no_fingerprint(spark):
    rows = spark.createDataFrame([(0, [1.0] * 65), (1, [2.0] + [1.0] * 63)], "vec_id long, embedding array<float>")
    assert {r.id: r.h for r in fingerprints_of(rows).collect()} == {0: None, 1: -(2**63)}
