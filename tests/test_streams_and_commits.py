"""State, timers, sweeps, commits and the job source."""

import datetime
import glob
import os
import random

import pandas as pd
import pytest
from plumbline.operators import fingerprint
from plumbline.sources import jobs as job_source
from plumbline.sources.commits import Batches, resume_batches
from plumbline.streaming.jobs import Retries, expiry_states, expiry_window, first_shared_key, near_uploads, retry_machine, stream_commit, stream_sweep
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, old)


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def drained(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_first_shared_key_is_that_of_the_keys(spark):
    rng = random.Random(1)
    pairs = [(a := rng.getrandbits(64), a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9)))) for _ in range(300)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for d in (1, 3):
        df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
        same = F.filter(F.zip_with(fingerprint.keys(F.col("a"), d), fingerprint.keys(F.col("b"), d), lambda x, y: F.when(x["piece"] == y["piece"], x["kind"])), lambda k: k.isNotNull())
        assert [r.k for r in df.select(F.array_min(same).alias("k")).collect()] == [first_shared_key(a, b, d) for a, b in pairs]


def test_near_uploads_on_a_stream_equal_prior_reports(rocks, tmp_path):
    spark, rng = rocks, random.Random(7)
    base = [rng.getrandbits(63) for _ in range(12)]
    near = lambda: rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3)))
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    batches = [[(100 * k + i, near(), at(10 * k + i % 7)) for i in range(30)] for k in range(2)]
    batches.append([(900, base[0], at(500)), (901, base[0], at(501))])  # long after: what was seen is over
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, h long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = arriving(spark, f"{tmp_path}/in", "id long, h long, ts timestamp")
    got = sorted(map(tuple, drained(near_uploads(stream, 3, datetime.timedelta(hours=1)), "near_uploads", "append").collect()))
    want, first = [], {}
    for i, h, _ in sorted(batches[0] + batches[1], key=lambda r: (r[2], r[0])):
        want += [(i, rep, (h ^ o).bit_count()) for o, rep in first.items() if (h ^ o).bit_count() <= 3]
        first.setdefault(h, i)
    assert got == sorted([*want, (901, 900, 0)])
    # the second batch against the first: the batch operator says the same
    prints = lambda rows: spark.createDataFrame([r[:2] for r in rows], "id long, h long")
    batch = fingerprint.prior_reports(prints(batches[1]), prints(batches[0]), 3)
    earlier = {i for i, _, _ in batches[0]}
    rep = {}
    for i, h, _ in sorted(batches[0], key=lambda r: (r[2], r[0])):
        rep.setdefault(h, i)
    of = {i: h for i, h, _ in batches[0]}
    assert sorted((r.a, rep[of[r.b]], r.distance) for r in batch.collect()) == [x for x in got if 100 <= x[0] < 200 and x[1] in earlier]


class Clock:
    """A processor's handle, state and time, set by hand."""

    def __init__(self):
        self.now, self.timers, self.value = 0, [], None

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):  # noqa: N802
        return iter(list(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_pauses_end_by_timer_and_jobs_fail_after_their_attempts():
    def run(attempts, steps):
        clock, out = Clock(), []
        job = Retries(attempts)
        job.init(clock)
        for n, (now, kind) in enumerate(steps):
            while clock.timers and min(clock.timers) <= now:
                clock.now = min(clock.timers)
                clock.timers.remove(clock.now)
                out += [(clock.now, *r[1:]) for r in pd.concat(job.handleExpiredTimer((1,), clock, None)).itertuples(index=False)]
            clock.now = now
            if kind:
                out += [(now, *r[1:]) for r in pd.concat(job.handleInputRows((1,), iter([pd.DataFrame({"ts": [now], "event_id": [n], "kind": [kind]})]), clock)).itertuples(index=False)]
        return out

    two = [(0, "processing"), (100, "error"), (1900, None), (2100, None), (2200, "processing"), (2300, "error"), (9000, None)]
    assert run(2, two) == [(0, "processing", 0, 0), (100, "paused", 1, 2000), (2100, "queued", 1, 0), (2200, "processing", 1, 0), (2300, "failed", 2, 0)]
    three = [(0, "error"), (2000, None), (2500, "error"), (6499, None), (6500, None), (7000, "complete"), (99_000, None)]
    assert run(3, three) == [(0, "paused", 1, 2000), (2000, "queued", 1, 0), (2500, "paused", 2, 4000), (6500, "queued", 2, 0), (7000, "complete", 2, 0)]
    assert run(2, [(0, "error"), (500, "complete"), (9000, None)]) == [(0, "paused", 1, 2000), (500, "complete", 1, 0)]  # gone on before its pause ended


def test_retries_on_a_stream(rocks, tmp_path):
    spark = rocks
    schema = "id long, ts timestamp, event_id long, kind string"
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), 1, "error"), (2, datetime.datetime(2024, 1, 1), 2, "complete")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    q = retry_machine(arriving(spark, f"{tmp_path}/in", schema), pause_ms=500).writeStream.format("memory").queryName("retries").outputMode("update").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            told = [(r.id, r.status, r.attempts) for r in spark.table("retries").collect()]
            if (1, "queued", 1) in told:
                break
    finally:
        q.stop()
    assert sorted(told) == [(1, "paused", 1), (1, "queued", 1), (2, "complete", 0)]


def test_expiry_equals_its_batch_twin(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(rng.randint(0, 20), at(h), at(h + rng.choice([5, 24]))) for h in range(40)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, ttl timestamp").coalesce(1)
    df.write.parquet(f"{tmp_path}/in/0")
    got = drained(expiry_window(arriving(spark, f"{tmp_path}/in", df.schema)), "expiry_twin", "append")
    assert sorted(map(str, got.collect())) == sorted(map(str, expiry_states(df).collect()))


def test_a_replayed_sweep_deletes_nothing_twice(spark, tmp_path):
    jobs = spark.createDataFrame([(i, f"k{i}") for i in range(10)], "id long, storage_key string").coalesce(1)
    calls, log = f"{tmp_path}/calls", Batches(spark, f"{tmp_path}/log")
    spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/ticks/0")
    os.mkdir(calls)

    def delete(key):
        open(f"{calls}/{key}-{random.SystemRandom().getrandbits(60)}", "w").close()
        if key == "k9" and os.path.exists(f"{tmp_path}/broken"):
            raise OSError("the store is gone")
        return key != "k3"

    def sweep(due):
        stream_sweep(arriving(spark, f"{tmp_path}/ticks", "id long"), lambda: due, delete, log, f"{tmp_path}/checkpoint").awaitTermination(120)

    times = lambda: sorted(os.path.basename(p).split("-")[0] for p in glob.glob(f"{calls}/*"))
    open(f"{tmp_path}/broken", "w").close()
    with pytest.raises(Exception, match="."):  # killed half way: nothing is in the log
        sweep(jobs)
    assert not log.manifests() and "k9" in times()
    os.remove(f"{tmp_path}/broken")
    for p in glob.glob(f"{calls}/*"):
        os.remove(p)
    sweep(jobs)
    assert times() == sorted(f"k{i}" for i in range(10)) and sorted(r.id for r in log.read("id long, storage_key string").collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    for p in glob.glob(f"{tmp_path}/checkpoint/commits/0") + glob.glob(f"{tmp_path}/checkpoint/commits/.0.crc"):
        os.remove(p)  # the batch's commit is lost: it runs again
    sweep(jobs)
    assert len(times()) == 10
    spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/ticks/1")
    sweep(jobs)  # the next tick asks only for what is not in the log
    assert times().count("k3") == 2 and len(times()) == 11 and len(log.manifests()) == 2


def test_concurrent_resumes_commit_each_key_once(spark, tmp_path):
    schema = "key long, by string"
    log = Batches(spark, f"{tmp_path}/cache")
    planned = spark.range(30).select(F.col("id").alias("key"))
    by = lambda name: lambda rows: rows.select("key", F.lit(name).alias("by"))
    assert resume_batches(log, planned.where("key < 5"), by("first"), schema) == 5

    def slow(rows):  # another writer commits while this one scores
        assert resume_batches(Batches(spark, f"{tmp_path}/cache"), planned.where("key % 2 = 0"), by("other"), schema) == 12
        return by("slow")(rows)

    assert resume_batches(log, planned, slow, schema) == 13
    got = {r.key: r.by for r in log.read(schema).collect()}
    assert log.read(schema).count() == 30 == len(got) and got == {k: "first" if k < 5 else "other" if k % 2 == 0 else "slow" for k in range(30)}
    log.write(spark.range(3).select(F.col("id").alias("key"), F.lit("half").alias("by")))  # never published
    assert log.read(schema).count() == 30
    assert log.append(planned.select("key", F.lit("b").alias("by")), "batch-1") and not log.append(planned.select("key", F.lit("b").alias("by")), "batch-1")
    assert log.read(schema, since=2).count() == 30


def test_committed_stream_batches_are_read_once(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    log = Batches(spark, f"{tmp_path}/out")
    for _ in range(2):
        stream_commit(arriving(spark, f"{tmp_path}/in", "id long"), lambda b: b, log, f"{tmp_path}/c").awaitTermination(120)
        for p in glob.glob(f"{tmp_path}/c/commits/*") + glob.glob(f"{tmp_path}/c/commits/.*crc"):
            os.remove(p)
    assert sorted(r.id for r in log.read("id long").collect()) == [0, 1, 2, 3]


def files_read(df):
    df.collect()
    found = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(found.apply(i).metrics().apply("numFiles").value() for i in range(found.size()) if found.apply(i).metrics().contains("numFiles"))


def test_job_source_prunes_folders_and_pushes_predicates(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=5)
    rows = [(i, i % 40 if i % 9 else None, "complete", day(i % 20 - 1), f"m{i}" if i % 3 else None, None, day(i % 20) if i % 11 else None) for i in range(800)]
    jobs = spark.createDataFrame(rows, job_source.JOBS)
    job_source.write_jobs(jobs, f"{tmp_path}/jobs")
    read = job_source.read_jobs(spark, f"{tmp_path}/jobs")
    every = len(glob.glob(f"{tmp_path}/jobs/*/*/*.parquet"))
    now = F.expr("timestamp '2024-01-03 05:00:00'")
    due = job_source.due_jobs(read, now, None)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "ttl_from" in plan.split("PartitionFilters:")[1].split("]")[0] and "LessThanOrEqual(ttl" in plan and "IsNull(media_deleted_at)" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert 0 < files_read(due) < every / 5
    assert sorted(r.id for r in due.collect()) == sorted(i for i, _, _, _, k, _, t in rows if k and t and t <= day(2))
    asked = spark.createDataFrame([(1, 10, 10), (2, 10, 11), (3, 50, 10), (4, 9, None), (5, 9999, 10)], "request_id long, id long, user_id long")
    own = job_source.owned_jobs(read, asked)
    assert {r.request_id: r.code for r in own.collect()} == {1: 200, 2: 404, 3: 200, 4: 404, 5: 404}
    assert "user_share" in own._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, read.select(*jobs.columns).collect())) == sorted(map(str, jobs.collect()))
