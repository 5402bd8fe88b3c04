import json

from pyspark.sql import functions as F

from plumbline.functions.scorers import batch_scorer, variants
from plumbline.operators import sampling
from plumbline.operators.rollup import pool_variants
from plumbline.queries import QUERIES
from plumbline.sources import reports, scores

SF = "/root/testdata/sf0.001"
LINE = {"key": "a", "label": 1, "spatial": None, "frequency": 0.5, "provenance_fired": False, "faces_found": 0, "dataset": "d"}


def test_corrupt_lines_are_skipped_and_later_files_win(spark, tmp_path):
    whole = json.dumps(LINE)
    (tmp_path / "1.jsonl").write_text("\n".join([whole, json.dumps({**LINE, "key": "b"}), whole[:30], json.dumps({k: v for k, v in LINE.items() if k != "spatial"} | {"key": "c"}), ""]))
    (tmp_path / "2.jsonl").write_text(json.dumps({**LINE, "frequency": 0.9}) + "\n")
    got = {r.key: r.frequency for r in scores.read_scores(spark, str(tmp_path)).collect()}
    assert got == {"a": 0.9, "b": 0.5}


def test_resume_appends_only_what_is_missing(spark, tmp_path):
    planned = spark.createDataFrame([("a",), ("b",)], "key string")
    score = lambda df: df.withColumn("score", F.lit(0.5))
    path = f"{tmp_path}/cache"
    score(planned.limit(1)).write.parquet(path)
    assert scores.resume_append(planned, spark.read.parquet(path), score, path) == 1
    assert scores.resume_append(planned, spark.read.parquet(path), score, path) == 2
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_calibration_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"temperature": {"a": 1.5, "b": "x"},\n "stream_weights": {"a": 0.7, "c": 0.3}}')
    got = {r.detector: (r.temperature, r.weight) for r in scores.read_calibration(spark, f"{tmp_path}/c.json").collect()}
    assert got == {"a": (1.5, 0.7), "c": (None, 0.3)}
    rows = spark.createDataFrame([("a", 1.5, 0.7, 0.9, "lift"), ("b", 2.0, None, 0.5, "left out")], "detector string, temperature double, weight double, auc double, rationale string")
    scores.write_calibration(rows, f"{tmp_path}/made", {"report": "r1"})
    assert sorted(map(str, scores.read_calibration(spark, f"{tmp_path}/made").select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    made = json.loads(next((tmp_path / "made").glob("part-*")).read_text())
    assert made["provenance"] == {"report": "r1"} and made["stream_weight_rationale"] == {"a": "lift", "b": "left out"}
    (tmp_path / "bad.json").write_text("{")
    assert scores.read_calibration(spark, f"{tmp_path}/bad.json").count() == 0
    assert scores.read_calibration(spark, f"{tmp_path}/none.json").count() == 0


def test_partitioned_scores_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, "d", 10, 7, "q90"), (2, "d", 10, 7, "q30")], "key int, dataset string, n int, seed int, variant string")
    scores.write_partitioned(df, f"{tmp_path}/p")
    one = spark.read.parquet(f"{tmp_path}/p").where("variant = 'q30'")
    assert [r.key for r in one.collect()] == [2] and "PartitionFilters: [isnotnull(variant" in one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "simple")


def test_latest_report(spark, tmp_path):
    for name in ("2024-01-02.json", "2024-01-10.json", "2024-01-09.json"):
        (tmp_path / name).write_text(name)
    (r,) = reports.latest_report(spark, str(tmp_path)).collect()
    assert r.value == "2024-01-10.json" and r.file.endswith("/2024-01-10.json")
    (tmp_path / "none").mkdir()
    assert reports.latest_report(spark, f"{tmp_path}/none").count() == 0


REPORT = [
    ("metrics", "d", "x", "auc", 0.9, None), ("metrics", "d", "x", "ece", None, None), ("metrics", "d", 'y "quoted"', "auc", 0.25, None),
    ("thresholds", "d", "x", "tpr at 0.01", None, "not measurable: 9 negatives"), ("weights", None, "x", "weight", 1.0, "why"),
]


def test_reports_keep_what_is_not_measurable(spark):
    rows = spark.createDataFrame(REPORT, reports.ROWS)
    got = {(r.section, r.detector, r.metric): (r.value, r.note) for r in reports.report_table(rows).collect()}
    assert got[("thresholds d", "x", "tpr at 0.01")] == ("\u2014", "not measurable: 9 negatives")
    assert got[("metrics d", "x", "ece")] == ("\u2014", "") and got[("metrics d", "x", "auc")] == ("0.9000", "")
    assert got[("weights", "x", "weight")] == ("1.0000", "why")
    (text,) = [r.value for r in reports.nested(rows).collect()]
    assert json.loads(text)["metrics"]["d"]["x"] == {"auc": {"v": 0.9}, "ece": {}}
    assert sorted(map(tuple, reports.read_nested(reports.nested(rows)).collect()), key=str) == sorted(REPORT, key=str)
    assert json.loads(reports.nested(rows.limit(0)).first().value) == {}
    assert {r.detector for r in reports.distinct_detectors(rows).collect()} == {"x", 'y "quoted"'}


def test_user_scorers(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id long, x array<double>")
    made = variants(rows, lambda batch, name: batch.assign(x=[v * (2 if name == "b" else 1) for v in batch["x"]]), ["a", "b"])
    scored = batch_scorer(made, lambda: lambda m: m @ [[0.0, 1.0], [0.0, 0.0]], "x", ["item_id", "variant"])
    pooled = {r.item_id: (r.score, r.n_variants) for r in pool_variants(scored).collect()}
    assert pooled[0] == (0.5, 2) and pooled[4][0] > pooled[1][0]


def test_labelled_members_reads_all_pages(spark, monkeypatch):
    seen, operator = [], sampling.labelled_members
    monkeypatch.setattr(sampling, "labelled_members", lambda members, *a: seen.append(members) or operator(members, *a))
    found = QUERIES["labelled_members"](spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    stems = lambda df, c: {r[0] for r in df.selectExpr(c).collect()}
    assert stems(seen[0], "regexp_replace(path, '[.](jpg|html)$', '')") == stems(pages, "substring_index(url, '?', 1)")
    assert 0 < found.count() < seen[0].count()
