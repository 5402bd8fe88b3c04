"""Job lifecycle: admission, ownership, state views, expiry, erasure, report validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.params import ACCEPTED, PARAMS


def rules(max_bytes: int) -> dict[str, tuple[Column, int, str]]:
    """Admission rules by name: condition to reject, status, reason."""
    return {
        "consent": (~F.coalesce("consent", F.lit(False)), 400, "no consent"),
        "file": (F.col("size").isNull(), 400, "no file"),
        "type": (~F.coalesce(F.col("mime").isin(ACCEPTED), F.lit(False)), 415, "unsupported type"),
        "empty": (F.col("size") == 0, 400, "empty file"),
        "large": (F.col("size") > max_bytes, 413, "too large"),
    }


GATE = ("consent", "file", "type", "empty", "large")
SERVICE = ("type", "large", "empty")


def admit(uploads: DataFrame, max_bytes: int, order: tuple[str, ...] = GATE) -> DataFrame:
    """``status`` and ``reason`` of the first rule, in ``order``, that rejects; 202 and null for admitted uploads. Stateless, so also for streams."""
    known, status, reason = rules(max_bytes), F, F
    for name in order:
        condition, code, why = known[name]
        status, reason = status.when(condition, code), reason.when(condition, why)
    return uploads.withColumns({"status": status.otherwise(202), "reason": reason.otherwise(F.lit(None).cast("string"))})


def owned_rows(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each request (request_id, id, user_id) with its job's columns; ``code`` 404 where no such job is the user's."""
    joined = requests.join(jobs.withColumn("_found", F.lit(True)), ["id", "user_id"], "left")
    return joined.withColumn("code", F.when(F.col("_found").isNull(), 404).otherwise(200)).drop("_found")


def job_state_view(jobs: DataFrame) -> DataFrame:
    """What a poll shows: report and deletion time of complete jobs, the error of failed ones, else the status alone."""
    complete, failed = F.col("status") == "complete", F.col("status") == "failed"
    return jobs.select("id", "status", F.when(complete, F.col("report")).alias("report"), F.when(complete, F.col("media_deleted_at")).alias("media_deleted_at"), F.when(failed, F.coalesce("error", F.lit("analysis failed"))).alias("error"))


def ttl_stamp(rows: DataFrame, hours: int = PARAMS.media_ttl_hours, created: str = "created_at") -> DataFrame:
    return rows.withColumn("ttl", F.col(created) + F.make_interval(hours=F.lit(hours)))


def access_state(requests: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """``code`` of each requested id: 404 unknown, 410 expired, else 200."""
    joined = requests.join(reports.select("id", "ttl", F.lit(True).alias("_found")), "id", "left")
    return joined.withColumn("code", F.when(F.col("_found").isNull(), 404).when(F.col("ttl") <= now, 410).otherwise(200)).drop("_found", "ttl")


def select_expired(jobs: DataFrame, now: Column, limit: int | None = PARAMS.sweep_limit) -> DataFrame:
    """Jobs whose media is due for deletion, oldest first; ``limit`` is the size of one sweep."""
    due = jobs.where((F.col("ttl") <= now) & F.col("storage_key").isNotNull() & F.col("media_deleted_at").isNull())
    return due.orderBy("ttl", "id").limit(limit) if limit else due


def mark_deleted(jobs: DataFrame, deleted: DataFrame, now: Column) -> DataFrame:
    """Stamps the jobs whose media was deleted (id) and forgets their key; row, report and hash stay."""
    joined = jobs.join(deleted.select("id", F.lit(True).alias("_gone")).distinct().hint("shuffle_hash"), "id", "left")
    gone = F.col("_gone").isNotNull()
    return joined.withColumns({"media_deleted_at": F.when(gone, now).otherwise(F.col("media_deleted_at")), "storage_key": F.when(~gone, F.col("storage_key"))}).drop("_gone")


def erase(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs without those that their owners (id, user_id) want erased; requests of others change nothing."""
    return jobs.join(requests.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def tolerant(reports: DataFrame, column: str, kind: str) -> DataFrame:
    """``column`` as an empty array where a report lacks it."""
    return reports.withColumn(column, F.coalesce(F.col(column), F.expr(f"cast(array() as {kind})")))


def violations(rows: DataFrame, checks: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, rule) for each rule that a row breaks; unknown values break none."""
    broken = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def violation_counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, broken) with zeros, in one pass."""
    sums = rows.agg(*[F.count_if(~ok).alias(name) for name, ok in checks.items()])
    return sums.unpivot([], list(checks), "rule", "broken")


def strict(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows, or an error at the first that breaks a rule."""
    fine = F.lit(True)
    for name, ok in checks.items():
        fine = fine & F.when(F.coalesce(ok, F.lit(True)), True).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean"))
    return rows.where(fine)
