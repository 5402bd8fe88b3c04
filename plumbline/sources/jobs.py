"""The job table as a source: declared schema, files by time of expiry and share of users, predicates that reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.jobs import owned_rows, select_expired
from plumbline.params import PARAMS

TIME = T.TimestampType()
JOBS = T.StructType().add("id", "long").add("user_id", "long").add("status", "string").add("created_at", TIME).add("storage_key", "string").add("media_deleted_at", TIME).add("ttl", TIME)
#: Folders: the start of the stretch in which a job expires, and the user's share.
LAYOUT = T.StructType().add("ttl_from", "date").add("user_share", "integer")
SHARES = 16


def ttl_from(ttl: Column, every: str = "day") -> Column:
    return F.date_trunc(every, ttl).cast("date")


def user_share(user_id: Column, shares: int = SHARES) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(shares)).cast("int")


def write_jobs(jobs: DataFrame, path: str, every: str = "day", shares: int = SHARES) -> None:
    """Jobs below a path, a folder for each stretch of ``every`` and share of users, in order of ttl; jobs without a ttl or a user have folders of their own."""
    laid = jobs.select(*[F.col(f.name).cast(f.dataType) for f in JOBS]).withColumns({"ttl_from": ttl_from(F.col("ttl"), every), "user_share": user_share(F.col("user_id"), shares)})
    laid.repartition("ttl_from", "user_share").sortWithinPartitions("ttl_from", "user_share", "ttl", "id").write.mode("append").partitionBy("ttl_from", "user_share").parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The jobs as declared, with the columns of the layout; no file is opened to learn a schema."""
    return spark.read.schema(T.StructType([*JOBS.fields, *LAYOUT.fields])).parquet(path)


def due_jobs(jobs: DataFrame, now: Column, limit: int | None = PARAMS.sweep_limit, every: str = "day") -> DataFrame:
    """``select_expired`` of ``read_jobs``: folders that start after ``now`` are not listed, and the files of others give only rows whose footers may hold what is due."""
    return select_expired(jobs.where(F.col("ttl_from") <= ttl_from(now, every)), now, limit).select(*JOBS.fieldNames())


def owned_jobs(jobs: DataFrame, requests: DataFrame, shares: int = SHARES) -> DataFrame:
    """``owned_rows`` for ``requests(request_id, id, user_id)``: only the shares of the users that ask are read, of which there are ``shares`` at most."""
    asked = sorted(r["s"] for r in requests.where(F.col("user_id").isNotNull()).select(user_share(F.col("user_id").cast("long"), shares).alias("s")).distinct().collect())
    own = jobs.where(F.col("user_share").isin(asked)) if asked else jobs.where(F.lit(False))
    return owned_rows(requests, own.select(*JOBS.fieldNames()))
