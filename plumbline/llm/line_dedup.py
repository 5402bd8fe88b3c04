"""Line deduplication over a sharded minimal perfect hash of the distinct lines.

Each distinct line hash is counted once across the corpus. The hashes are dealt into shards; each shard becomes
one minimal perfect hash (hash-and-displace) that indexes three flat arrays: a 32-bit fingerprint, a saturated
document count and the largest document id. Documents probe these arrays with the hashes of their lines; no line is
joined with another line.

Rules: a line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least ``min_chars`` code
points in at least ``min_docs`` documents lose their lines everywhere except in the document with the largest id. A key
repeated inside the surviving document stays as often as it is there. Rows that repeat a doc_id are one document. Rows
without an id are one document, smaller than any other. Null and empty texts are one empty line. Extra columns of the input pass through untouched, but
for those named ``n_lines`` or ``n_dropped``, which the results replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, ascii_lower, fresh, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys of one shard at most on average, and probes of one task at most on average: bounds a task's memory.
SHARD_KEYS = 20_000
TASK_PROBES = 20_000
#: Keys of one displacement bucket on average: few, so that the last buckets of two keys still find free places soon.
BUCKET_KEYS = 2.5
#: Set in the seed of a bucket of one key: the other bits are its place.
DIRECT = np.uint32(1 << 31)
INDEX = "shard int, n long, seeds binary, prints binary, counts binary, holders binary"
NO_DOC = -(2**63)


def mixed(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit finaliser over hashes and displacement seeds."""
    with np.errstate(over="ignore"):
        z = x + np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def buckets_of(n: int) -> int:
    return max(1, int(n / BUCKET_KEYS))


def slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Place of each key in the arrays of its shard."""
    seed = seeds[mixed(keys, 0) % np.uint64(buckets_of(n))]
    at = (mixed(keys, (seed & ~DIRECT) + np.uint32(1)) % np.uint64(n)).astype(np.int64)
    return np.where(seed & DIRECT, (seed & ~DIRECT).astype(np.int64), at)


def perfect_seeds(keys: np.ndarray) -> np.ndarray:
    """One displacement seed a bucket, such that ``slots`` maps the distinct ``keys`` onto 0..n-1 without collision.

    Large buckets go first; all buckets of one size try a seed together, and of those that clash the first wins.
    Buckets of one key name their place directly.
    """
    n = len(keys)
    seeds = np.zeros(buckets_of(n), dtype=np.uint32)
    bucket = (mixed(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(seeds))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    taken = np.zeros(n, dtype=bool)
    for size in range(int(sizes.max()), 1, -1):
        waiting = np.flatnonzero(sizes == size)
        members = keys[order[first[waiting][:, None] + np.arange(size)]]
        seed = 0
        while len(waiting):
            at = np.sort((mixed(members, seed + 1) % np.uint64(n)).astype(np.int64), axis=1)
            rows = np.flatnonzero(~taken[at].any(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1))
            owner = np.full(n, len(waiting), dtype=np.int64)
            np.minimum.at(owner, at[rows].ravel(), np.repeat(rows, size))
            won = rows[(owner[at[rows]] == rows[:, None]).all(axis=1)]
            taken[at[won].ravel()] = True
            seeds[waiting[won]] = seed
            waiting, members, seed = np.delete(waiting, won), np.delete(members, won, axis=0), seed + 1
    single = np.flatnonzero(sizes == 1)
    seeds[single] = np.flatnonzero(~taken)[: len(single)].astype(np.uint32) | DIRECT
    return seeds


def build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """The arrays of one shard from its distinct (hash, n_docs, last_doc) rows."""
    keys = rows["hash"].to_numpy().view(np.uint64)
    n = len(keys)
    seeds = perfect_seeds(keys)
    at = slots(keys, seeds, n)
    prints, counts, holders = np.empty(n, np.uint32), np.empty(n, np.uint8), np.empty(n, np.int64)
    prints[at] = (keys >> np.uint64(32)).astype(np.uint32)
    counts[at] = np.minimum(rows["n_docs"].to_numpy(), 255)
    holders[at] = rows["last_doc"].to_numpy()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": [n], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("seeds", seeds), ("prints", prints), ("counts", counts), ("holders", holders))}})


def prober(min_docs: int):
    def probe(key: tuple, lines: pa.Table, index: pa.Table) -> pa.Table:
        """Of one task's lines, those that the arrays tell to drop."""
        out = lines.select(["doc", "text_hash", "pos"])
        if not len(lines) or not len(index):
            return out.slice(0, 0)
        shard = index.slice(0, 1).to_pylist()[0]
        keys = lines["hash"].to_numpy().view(np.uint64)
        at = slots(keys, np.frombuffer(shard["seeds"], np.uint32), shard["n"])
        known = np.frombuffer(shard["prints"], np.uint32)[at] == (keys >> np.uint64(32)).astype(np.uint32)
        many = np.frombuffer(shard["counts"], np.uint8)[at] >= min_docs
        elsewhere = np.frombuffer(shard["holders"], np.int64)[at] != lines["doc"].to_numpy()
        return out.filter(pa.array(known & many & elsewhere))

    return probe


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The sharded arrays over the distinct hashes of ``lines(hash, doc)``, one row a line and document; and the number of shards."""
    counted = written(lines.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc")), "line-counts")
    shards = max(1, -(-counted.count() // shard_keys))
    dealt = counted.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(build_shard, INDEX), "line-index"), shards


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> DataFrame:
    """One row (doc, text_hash, dropped array<int> of line positions) for each document that loses lines."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255")
    line = F.expr("transform(split(_text, '\n', -1), (x, i) -> struct(i as pos, x as line))")
    cut = docs.select(F.coalesce("doc_id", F.lit(NO_DOC)).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("_text"))
    # the hash before the explosion: beside it, it would be worked out for each line
    cut = cut.select("doc", F.xxhash64("_text").alias("text_hash"), line.alias("lines")).select("doc", "text_hash", F.explode("lines").alias("l"))
    keyed = cut.select("doc", "text_hash", F.col("l.pos").alias("pos"), line_key(F.col("l.line")).alias("key"))
    keyed = keyed.where(F.length("key") >= min_chars).select("doc", "text_hash", "pos", F.xxhash64("key").alias("hash"))
    keyed = written(keyed, "lines")
    index, shards = line_index(keyed.select("hash", "doc").distinct(), shard_keys)
    shard = F.pmod("hash", F.lit(shards)).cast("int").alias("shard")
    # shards with many probes are split; at most one row for each task_probes of them, so that these can be broadcast
    split = keyed.groupBy(shard).count().where(F.col("count") > 4 * task_probes)
    split = F.broadcast(written(split.select("shard", F.ceil(F.col("count") / task_probes).cast("int").alias("salts")), "line-salts"))
    salts = F.coalesce("salts", F.lit(1))
    probes = keyed.select("*", shard).join(split, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), salts).cast("int"))
    arrays = index.join(split, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    kind = ", ".join(f"{c} {t}" for c, t in keyed.select("doc", "text_hash", "pos").dtypes)
    hits = probes.drop("salts").groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInArrow(prober(min_docs), kind)
    return hits.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``text`` cut to its kept lines and the added columns ``n_lines`` and ``n_dropped`` (long)."""
    drops = dropped_lines(docs, min_chars, min_docs, shard_keys, task_probes)
    doc, hash_, gone = (fresh(name, docs.columns) for name in ("_doc", "_text_hash", "_dropped"))
    drops = drops.select(F.col("doc").alias(doc), F.col("text_hash").alias(hash_), F.col("dropped").alias(gone))
    body = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce("text", F.lit("")))
    joined = body.join(drops.hint("shuffle_hash"), (F.coalesce(body["doc_id"], F.lit(NO_DOC)).cast("long") == F.col(doc)) & (F.xxhash64(body["text"]) == F.col(hash_)), "left")
    n_dropped = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    # the lines are split once, and the places to keep are found by hashing: linear in the lines
    places = f"array_except(sequence(0, size(lines) - 1), `{gone}`)"
    kept = F.expr(f"transform(array(split(text, '\n', -1)), lines -> array_join(transform({places}, i -> lines[i]), '\n'))[0]")
    cut = joined.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")).withColumn("n_dropped", n_dropped)
    return cut.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).drop(doc, hash_, gone)
