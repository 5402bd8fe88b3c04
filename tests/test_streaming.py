
import datetime

from pyspark.sql import functions as F

from plumbline import fixtures

from plumbline.operators.jobs import admit
from plumbline.plans.retention import sweep
from plumbline.plans.scoring import score_items
from plumbline.streaming.jobs import expiry_window, final_status, progress_counts, repeat_uploads, status_machine, stream_admit, stream_score

SF = "/root/testdata/sf0.001"


def source(spark, name):
    schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(SF)


def drained(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def rows(df):
    return sorted(map(str, df.collect()))


def test_admission_splits_a_stream_as_the_batch_does(spark, tmp_path):
    stream = source(spark, "documents").select(F.col("doc_id").alias("id"), F.lit("image/png").alias("mime"), F.col("n_chars").alias("size"), (F.col("doc_id") % 9 != 0).alias("consent"))
    stream_admit(stream, 4000, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    batch = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("image/png").alias("mime"), F.col("n_chars").alias("size"), (F.col("doc_id") % 9 != 0).alias("consent"))
    want = admit(batch, 4000)
    for path, wanted in (("in", "status = 202"), ("out", "status <> 202")):
        assert rows(spark.read.parquet(f"{tmp_path}/{path}").select("id", "status", "reason")) == rows(want.where(wanted).select("id", "status", "reason"))


def test_scoring_sink_is_idempotent(spark, tmp_path):
    for _ in range(2):  # the same checkpoint: the second run finds nothing new
        stream_score(source(spark, "labels"), lambda b: b.select("doc_id", (F.col("quality") * 0.5).alias("score")), f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/s").count() == spark.read.parquet(f"{SF}/labels.parquet").count()


def test_status_machine_equals_its_batch_twin(spark):
    kind = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("other")
    pick = lambda df: df.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(status_machine(pick(source(spark, "events"))), "statuses", "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert rows(got.select("id", "status", "attempts")) == rows(final_status(pick(spark.read.parquet(f"{SF}/events.parquet"))))


def test_final_status_by_stretches_equals_a_plain_fold(spark):
    import random

    rng = random.Random(1)
    rows, want = [], {}
    for job in range(60):
        status, tried = "queued", 0
        times = sorted(rng.randint(0, 20_000) for _ in range(rng.randint(1, 12)))
        for k, t in enumerate(times):
            kind = rng.choice(["processing", "error", "other", "complete"] if rng.random() < 0.3 else ["processing", "other", "error"])
            rows.append((job, k, t, kind))
            if status in ("complete", "failed"):
                continue
            if kind in ("processing", "complete"):
                status = kind
            elif kind == "error":
                tried += 1
                status = "failed" if tried >= 2 else "queued"
        want[job] = (status, tried)
    df = spark.createDataFrame(rows, "id long, event_id long, t long, kind string").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.id: (r.status, r.attempts) for r in final_status(df).collect()} == want
    assert final_status(df.limit(0)).count() == 0


def test_the_scoring_plan_runs_on_a_stream(spark, tmp_path):
    tie, parts = ("line", "part", "supp"), fixtures.parts(spark, SF)
    score = lambda items: score_items(items, parts.join(items.select("item_id").hint("shuffle_hash"), "item_id", "left_semi"), {"spatial": 0.7, "frequency": 0.3}, tie)
    items = lambda orders: fixtures.items_of(orders)
    stream_score(items(source(spark, "orders")), score, f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/s").drop("batch")
    assert rows(got) == rows(score(items(spark.read.parquet(f"{SF}/orders.parquet"))))


def test_reports_expire_by_event_time(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    batches = [[(1, at(0), at(24)), (2, at(1), at(25))], [(3, at(24.5), at(48.5)), (2, at(24.5), at(50))], [(4, at(49), at(73))], [(5, at(80), at(104))]]
    schema = "id long, created_at timestamp, ttl timestamp"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(expiry_window(stream), "expiring", "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    ends = {(r.id, r.ttl) for r in got.where("state = 'expired'").collect()}
    assert ends == {(1, at(24)), (3, at(48.5)), (2, at(50)), (4, at(73))}  # renewed once, expired once; the last is still live
    assert {r.id for r in got.where("state = 'live'").collect()} == {1, 2, 3, 4, 5}


def test_windows_and_repeats(spark):
    pick = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("dataset"), F.when(F.col("value") >= 10, F.col("value")).alias("score"), F.col("user_id").alias("phash"))
    got = drained(progress_counts(pick(source(spark, "events")), "1 day", "1 hour"), "progress", "complete")
    want = progress_counts(pick(spark.read.parquet(f"{SF}/events.parquet")), "1 day", "1 hour")
    assert rows(got) == rows(want)
    seen = drained(repeat_uploads(pick(source(spark, "events")), "60 days"), "seen", "append")
    assert seen.count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()


def test_sweep_marks_only_what_was_deleted_however_often_it_is_read(spark, tmp_path):
    data = [(1, "a", "2020-01-01", None), (2, "b", "2020-01-02", None), (3, None, "2020-01-01", None), (4, "d", "2030-01-01", None), (5, "e", "2020-01-01", "2020-02-01")]
    df = spark.createDataFrame(data, "id long, storage_key string, t string, g string").select("id", "storage_key", F.col("t").cast("timestamp").alias("ttl"), F.col("g").cast("timestamp").alias("media_deleted_at"))
    marks = f"{tmp_path}/gone"

    def delete(key):  # tells the truth: a key can be deleted once
        with open(marks, "a+") as f:
            f.seek(0)
            if key == "b" or key in f.read().split():
                return False
            f.write(f"{key}\n")
            return True

    done = sweep(df, F.expr("timestamp '2021-01-01'"), delete)
    done.count()
    assert {r.id: (r.storage_key, r.media_deleted_at is None) for r in done.collect()} == {1: (None, False), 2: ("b", True), 3: (None, True), 4: ("d", True), 5: ("e", False)}
