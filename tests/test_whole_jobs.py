"""Queries tell all that they told before, and their steps stay bounded on larger tables."""

from plumbline.functions.tables import written
from plumbline.operators import grids, provenance
from plumbline.plans.protocol import cross_dataset
from plumbline.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_band_labels_tells_of_missing_labels(spark):
    found = QUERIES["band_labels"](spark, SF)
    assert set(found.columns) == {"label", "never_null", "n"} and "as never_null" in ORACLE["band_labels"]
    assert {r.never_null for r in found.collect()} == {False}


def test_tiles_are_dealt_by_cells_not_by_bytes(spark, monkeypatch):
    """Dense cells compress well: tasks sized by the shuffle's bytes held ever more of them."""
    cells = written(spark.range(60).select(F.col("id").alias("grid_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("at")).select("grid_id", F.floor(F.col("at") / 10).cast("int").alias("y"), (F.col("at") % 10).alias("x"), F.lit(0.5).alias("v")), "cells")
    mean = lambda t: {"n": [t.own.size], "total": [t.own.sum()]}
    for few in (100, 10):  # sizes of grids are broadcast, or meet their cells by hash
        monkeypatch.setattr(grids, "FEW", few)
        found = grids.by_tile(cells, mean, "n long, total double", task_cells=500)
        assert found.rdd.getNumPartitions() == 12
        assert sorted((r.grid_id, r.n, r.total) for r in found.collect()) == [(k, 100, 50.0) for k in range(60)]


def test_one_automaton_of_markers_at_a_time(spark):
    """However many parts a marker table has, a task holds one of them; equal markers are one, told by the first."""
    texts = spark.range(200).select("id", F.concat(F.lit("see Word"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    markers = spark.range(400).select((F.col("id") % 200).cast("int").alias("pos"), F.concat(F.lit("word"), (F.col("id") % 200).cast("string"), F.lit(".")).alias("marker"), F.when(F.col("id") < 200, "b").otherwise("a").alias("label"))
    found = provenance.marker_join(texts, markers, trie_bytes=300)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.columns == ["id", "text", "label"] and {tuple(r) for r in found.select("label").collect()} == {("a",)}
    assert found.count() == 200


def test_protocol_scores_a_sweep_once(spark):
    """Scores may cost much: the rows that the measurable groups are chosen from and those that are kept are the same table."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    base = spark.range(120).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 60, "a").otherwise("b").alias("dataset"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7 / 7.0).alias("spatial"))
    rows = base.select("key", F.lit("90").alias("variant"), "label", "spatial")
    frames = cross_dataset(base, ["spatial"], "a", "b", sweep=rows.mapInArrow(counted, rows.schema))
    assert [r.variant for r in frames["robustness"].collect()] == ["90"]
    assert seen.value == 120
