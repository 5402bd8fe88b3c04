"""Streaming forms of the job lifecycle."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.functions.tables import written
from plumbline.operators.fingerprint import JOINED, keys
from plumbline.operators.jobs import admit
from plumbline.params import PARAMS
from plumbline.sources.commits import Batches


def stream_admit(uploads: DataFrame, max_bytes: int, admitted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Splits a stream of uploads into two Parquet sinks; a replayed batch overwrites its own files."""

    def split(batch: DataFrame, number: int) -> None:
        checked = admit(batch, max_bytes)
        for path, rows in ((admitted, checked.where("status = 202")), (rejected, checked.where("status <> 202"))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return uploads.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_commit(queued: DataFrame, score: Callable[[DataFrame], DataFrame], batches: Batches, checkpoint: str) -> StreamingQuery:
    """Reports of queued items, committed a micro-batch at a time: a replayed or half-written one is never read, even by readers that list files."""
    return queued.writeStream.foreachBatch(lambda batch, number: batches.append(score(batch), f"stream-{number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_score(queued: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Reports of queued items, one folder a batch, so that a replay is idempotent."""

    def run(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queued.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "id long, status string, attempts int, backoff_ms long"


class JobStatus(StatefulProcessor):
    """Status of each job from its events: failed only after all attempts, with an exponential pause before each new one."""

    def __init__(self, attempts: int = PARAMS.attempts, pause_ms: int = 2000):
        self.attempts, self.pause_ms = attempts, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts = self.state.get() if self.state.exists() else ("queued", 0)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for kind in events["kind"]:
            if status in ("complete", "failed"):
                break
            if kind == "processing":
                status = "processing"
            elif kind == "complete":
                status = "complete"
            elif kind == "error":
                attempts += 1
                status = "failed" if attempts >= self.attempts else "queued"
        self.state.update((status, attempts))
        pause = self.pause_ms * 2 ** (attempts - 1) if status == "queued" and attempts else 0
        yield pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [attempts], "backoff_ms": [pause]})

    def close(self) -> None:
        pass


class Retries(JobStatus):
    """Job status whose pauses a timer ends: a failed attempt is *paused*, and *queued* again after its pause, unless the job has gone on by then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (row,) = super().handleInputRows(key, rows, timerValues)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        pause = int(row["backoff_ms"].iloc[0])
        if pause:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + pause)
            row["status"] = "paused"
        yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts = self.state.get()
        yield pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [attempts], "backoff_ms": [0]})


def retry_machine(events: DataFrame, attempts: int = PARAMS.attempts, pause_ms: int = 2000) -> DataFrame:
    """``status_machine`` that acts on pauses: a stream whose *queued* rows with attempts are what a worker takes again. Needs the RocksDB state store."""
    return events.groupBy("id").transformWithStateInPandas(Retries(attempts, pause_ms), STATE, "Update", "ProcessingTime")


SWEPT = "id long, storage_key string"


def stream_sweep(ticks: DataFrame, due: Callable[[], DataFrame], delete: Callable[[str], bool], log: Batches, checkpoint: str, **trigger) -> StreamingQuery:
    """Deletes what is due at each tick: a micro-batch of ``ticks`` (a rate source, any stream) is one sweep over ``due()`` jobs (id, storage_key).

    A sweep commits the jobs whose media it deleted to ``log`` under its batch number, once: a replay of a batch that is in the log does nothing, and keys in the log are never asked for
    again. Of a sweep that was killed before its commit nothing is in the log; its keys are deleted again, so ``delete`` must tell true of a key that is gone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = pa.array([delete(k) for k in batch.column("storage_key").to_pylist()], pa.bool_())
            yield batch.filter(gone)

    def sweep(batch: DataFrame, number: int) -> None:
        name = f"sweep-{number}"
        if not log.has(name):
            rows = due().select("id", "storage_key").join(log.read(SWEPT).select("id"), "id", "left_anti").select(F.col("id").cast("long").alias("id"), "storage_key")
            log.append(written(rows.mapInArrow(run, SWEPT), "swept"), name)

    return ticks.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def status_machine(events: DataFrame, attempts: int = PARAMS.attempts) -> DataFrame:
    """Stream of (id, status, attempts, backoff_ms) from events (id, ts, event_id, kind); needs the RocksDB state store."""
    return events.groupBy("id").transformWithStateInPandas(JobStatus(attempts), STATE, "Update", "None")


def final_status(events: DataFrame, attempts: int = PARAMS.attempts, every: str = "hour") -> DataFrame:
    """The batch twin: each job's status after all its events (id, ts, event_id, kind).

    Events are summed by job and ``every`` stretch of time; running sums over the stretches find the one in which a job ends, and only in that one the
    order of events counts. So a job with a large share of all events is spread over its stretches.
    """
    kind = F.col("kind")
    telling = F.when(kind.isin("processing", "complete", "error"), F.struct("ts", "event_id"))
    sums = [F.count_if(kind == "error").alias("errors"), F.count_if(kind == "complete").alias("done"), F.max_by("kind", telling).alias("last"), F.max(telling).alias("last_at")]
    dated = events.withColumn("stretch", F.date_trunc(every, "ts"))
    stretches = dated.groupBy("id", "stretch").agg(*sums)
    before = Window.partitionBy("id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    stretches = stretches.withColumns({"errors_before": zero("errors"), "done_before": zero("done")})
    over_before = (F.col("done_before") > 0) | (F.col("errors_before") >= attempts)
    over_after = (F.col("done_before") + F.col("done") > 0) | (F.col("errors_before") + F.col("errors") >= attempts)
    open_ = stretches.where(~over_before)
    whole = open_.where(~over_after).select("id", "errors", "last", "last_at")
    # the stretch in which the job ends, up to the event that ends it
    ending = open_.where(over_after).select("id", "stretch", "errors_before")
    inside = Window.partitionBy("id", "stretch").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = dated.join(ending.hint("shuffle_hash"), ["id", "stretch"]).select("id", "ts", "event_id", "kind", F.coalesce(F.count_if(kind == "complete").over(inside), F.lit(0)).alias("c"), (F.col("errors_before") + F.coalesce(F.count_if(kind == "error").over(inside), F.lit(0))).alias("e"))
    cut = ended.where((F.col("c") == 0) & (F.col("e") < attempts)).groupBy("id").agg(*sums).select("id", "errors", "last", "last_at")
    jobs = whole.unionByName(cut).groupBy("id").agg(F.sum("errors").cast("int").alias("attempts"), F.max_by("last", "last_at").alias("last"))
    status = F.when(F.col("last") == "processing", "processing").when(F.col("last") == "complete", "complete").when((F.col("last") == "error") & (F.col("attempts") >= attempts), "failed").otherwise("queued")
    return jobs.select("id", status.alias("status"), "attempts")


class Expiry(StatefulProcessor):
    """Reports live until their time; then their key's state and row go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("report", "ttl_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max(int(t.value // 1_000_000) for batch in rows for t in batch["ttl"])
        if self.state.exists():
            old = self.state.get()[0]
            if last <= old:
                return
            self.handle.deleteTimer(old)
        self.state.update((last,))
        self.handle.registerTimer(last)
        yield pd.DataFrame({"id": [key[0]], "state": ["live"], "ttl": [pd.Timestamp(last, unit="ms")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.state.clear()
        yield pd.DataFrame({"id": [key[0]], "state": ["expired"], "ttl": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def expiry_window(reports: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Stream of (id, state, ttl) from reports (id, created_at, ttl): *live* as they come, *expired* once event time passes their ttl; a report that comes after its ttl is dropped as late. Needs the RocksDB state store."""
    return reports.withWatermark("created_at", late).groupBy("id").transformWithStateInPandas(Expiry(), "id long, state string, ttl timestamp", "Append", "EventTime")


def first_shared_key(a: int, b: int, distance: int) -> int | None:
    """Number of the first of ``fingerprint.keys`` that two fingerprints share: that of their first ``JOINED`` equal pieces."""
    n = distance + JOINED
    edges = [64 * i // n for i in range(n + 1)]
    equal = [i for i in range(n) if not (a ^ b) >> edges[i] & ((1 << (edges[i + 1] - edges[i])) - 1)]
    return KINDS[n][tuple(equal[:JOINED])] if len(equal) >= JOINED else None


KINDS = {n: {c: k for k, c in enumerate(combinations(range(n), JOINED))} for n in range(JOINED + 1, JOINED + 9)}
UNSIGNED = (1 << 64) - 1


class NearPrints(StatefulProcessor):
    """The fingerprints seen under one key, each with the upload that had it first; they go once event time has passed their life."""

    def __init__(self, distance: int, live_ms: int):
        self.distance, self.live_ms = distance, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getMapState("prints", "h long", "id long, ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        found, changed, last = [], set(), 0
        for r in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            now = int(r.ts.value // 1_000_000)
            for h, (first, at) in known.items():
                apart = ((r.h ^ h) & UNSIGNED).bit_count()
                # of all keys that a pair shares one tells it
                if apart <= self.distance and now - at <= self.live_ms and first_shared_key(r.h & UNSIGNED, h & UNSIGNED, self.distance) == key[0]:
                    found.append((r.id, first, apart))
            first, at = known.get(r.h, (r.id, now))
            known[r.h] = (first if now - at <= self.live_ms else r.id, now)
            changed.add(r.h)
            last = max(last, now)
        for h in changed:
            self.seen.updateValue((h,), known[h])
        self.handle.registerTimer(last + self.live_ms + 1)
        yield pd.DataFrame(found, columns=["a", "b", "distance"]).astype({"a": "int64", "b": "int64", "distance": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        over = expiredTimerInfo.getExpiryTimeInMs() - self.live_ms
        for h in [k for k, v in self.seen.iterator() if v[1] < over]:
            self.seen.removeKey(h)
        yield pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


def near_uploads(uploads: DataFrame, distance: int, live: datetime.timedelta, late: str = "0 seconds") -> DataFrame:
    """Stream of (a, b, distance): each upload (id, h, ts) with the uploads before it, at most ``live`` ago, whose fingerprints are equal or within ``distance``; equal ones are told by the first of them.

    The streaming form of ``fingerprint.prior_reports``, by the same keys: state is held by key, and goes with event time. Needs the RocksDB state store.
    """
    if not 1 <= distance <= 8:
        raise ValueError("distance must be from 1 to 8")
    keyed = uploads.withWatermark("ts", late).select("id", "h", "ts", F.inline(keys(F.col("h"), distance)))
    return keyed.groupBy("kind", "piece").transformWithStateInPandas(NearPrints(distance, int(live.total_seconds() * 1000)), "a long, b long, distance int", "Append", "EventTime")


def expiry_states(reports: DataFrame) -> DataFrame:
    """The batch twin of ``expiry_window`` on reports that come together: (id, state, ttl) of each report's last ttl, and again as *expired* where the newest report was created at or after it."""
    last = reports.groupBy("id").agg(F.max("ttl").alias("ttl"))
    newest = reports.agg(F.max("created_at").alias("newest"))  # one row
    over = last.join(F.broadcast(newest), F.col("ttl") <= F.col("newest"))
    return last.select("id", F.lit("live").alias("state"), "ttl").unionByName(over.select("id", F.lit("expired").alias("state"), "ttl"))


def repeat_uploads(uploads: DataFrame, ttl: str) -> DataFrame:
    """First uploads of each fingerprint (phash, ts) within the watermark; repeats are dropped, state older than ``ttl`` too."""
    return uploads.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["phash"])


def progress_counts(samples: DataFrame, every: str, late: str) -> DataFrame:
    """Counts of scored samples and those without a part by dataset and window of ``ts``."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", every), "dataset").agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("n_without_part"))


def timeline_windows(points: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean score of each item by tumbling or sliding window of ``ts``."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    return points.withWatermark("ts", late).groupBy("item_id", at.alias("w")).agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def bursts(points: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each item: points with less than ``gap`` between them."""
    return points.withWatermark("ts", late).groupBy("item_id", F.session_window("ts", gap).alias("w")).agg(F.max("score").alias("score"), F.count("*").alias("n"))
