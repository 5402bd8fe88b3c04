"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import pack_bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str, least: str = "0") -> DataFrame:
    """Scored samples with labels: key, dataset, label, spatial (null for short texts), frequency.

    ``least``: a robustness variant, scored without the words whose md5 starts with a lower hex digit; null where no word is left.
    """
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")
    words = F.split(F.lower(text), " ")
    kept = words if least == "0" else F.filter(words, lambda w: F.md5(w) >= least)
    share = F.round(F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.length(text).cast("double"), 4)
    variety = F.round(F.size(F.array_distinct(kept)) / F.when(F.size(kept) > 0, F.size(kept)).cast("double"), 4)
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("key"),
        F.when(F.col("lang") == "en", "calib").otherwise("report").alias("dataset"),
        F.col("quality").alias("label"),
        F.when(F.col("n_chars") >= 60, share).alias("spatial"),
        variety.alias("frequency"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of items: lines of orders, with measured columns. No part_index yet; ``line``, ``part`` and ``supp`` break ties."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("item_id"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"),
        c("l_quantity").cast("int").alias("w"), (1 + c("l_partkey") % 160).cast("int").alias("h"),
        F.round(c("l_discount") * 10, 4).alias("raw_score"), F.round(c("l_tax") / 10, 4).alias("spread"),
        (c("l_suppkey") * 37 % 500).cast("double").alias("blur"), (c("l_partkey") * 7 % 256).cast("double").alias("luma"),
        (40 + c("l_linenumber") * 8).cast("int").alias("jpeg_q"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their own measurements and provenance facts: orders."""
    return items_of(table(spark, sf_dir, "orders"))


def items_of(orders: DataFrame) -> DataFrame:
    c = F.col
    return orders.select(
        c("o_orderkey").alias("item_id"), (c("o_custkey") * 13 % 400).cast("double").alias("blur"), (c("o_orderkey") * 11 % 256).cast("double").alias("luma"),
        F.when(c("o_orderkey") % 5 != 0, (40 + c("o_custkey") % 60).cast("int")).alias("jpeg_q"),
        (F.floor("o_totalprice") % 1000 / 1000).alias("frequency"),
        F.when(c("o_orderkey") % 11 == 0, "FLUX").alias("marker"),
        F.when(c("o_orderkey") % 3 != 0, c("o_orderkey") % 4 == 0).alias("manifest_valid"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table: id, user_id, status, created_at, storage_key, media_deleted_at, ttl."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 17 == 0, "failed").otherwise(status).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("media/"), F.col("o_orderkey").cast("string"))).alias("storage_key"),
        F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderdate").cast("timestamp")).alias("media_deleted_at"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads: id, mime, size, consent; from documents."""
    return uploads_of(table(spark, sf_dir, "documents"))


def uploads_of(documents: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("image/jpeg", "image/png", "image/webp", "text/plain", "image/bmp")])
    size = F.when(F.col("doc_id") % 23 == 0, 0).otherwise(F.col("n_chars"))
    return documents.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 != 0, F.get(kinds, (F.col("doc_id") % 5).cast("int"))).alias("mime"),
        size.cast("long").alias("size"), (F.col("doc_id") % 9 != 0).alias("consent"),
    )


def fingerprints_of(embeddings: DataFrame) -> DataFrame:
    """(id, h): a 64-bit fingerprint of each embedding."""
    return embeddings.select(F.col("vec_id").alias("id"), pack_bits(F.transform("embedding", lambda x: x.cast("double"))).alias("h"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints of the embeddings, and near copies of each fifth with up to two bits flipped."""
    own = fingerprints_of(table(spark, sf_dir, "embeddings"))
    flip = lambda k: F.expr(f"shiftleft(1L, cast(id * {k} % 64 as int))")
    near = own.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("h").bitwiseXOR(flip(1)).bitwiseXOR(flip(7)).alias("h"))
    return own.unionByName(near)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense grids of 31 x 24 cells (days x hours of each user's events): grid_id, y, x, v."""
    e = table(spark, sf_dir, "events")
    day, hour = F.dayofmonth("ts") - 1, F.hour("ts")
    sums = e.groupBy(F.col("user_id").alias("grid_id"), (day * 24 + hour).alias("at")).agg(F.round(F.sum("value"), 2).alias("v"))
    held = sums.groupBy("grid_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("held"))  # at most 744 entries
    dense = held.select("grid_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(743)), lambda at: F.coalesce(F.try_element_at("held", at), F.lit(0.0)))).alias("at", "v"))
    return dense.select("grid_id", F.floor(F.col("at") / 24).cast("int").alias("y"), (F.col("at") % 24).alias("x"), "v")
