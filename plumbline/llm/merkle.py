"""Merkle manifest of a dataset: a digest for each row, one for each language, one for all, and a proof for each row.

A leaf is H of a row's five fields, H being the lowercase hex SHA-256 of its inputs one after another (digests as hex text; a field as ``-`` if null, else the
length in UTF-8 bytes, ``:`` and the value). The leaves of a language ascend by doc_id; every ``FAN`` consecutive nodes become their H, level by level, until one remains: the
language's subroot (a lone leaf itself). Subroots, ordered by language (null first), likewise give the root.

The tree is a content-addressed store, one record (height, digest, children) a node. Requests for leaves descend from the root: at each level those that
have the same way so far travel as one row, which looks up its digest's children, and goes on to each child asked for, by the next base-``FAN`` digit of the rank; the children
not selected are the level's segment of the path. Reversed, the segments lead from the leaf up to the root. Only the last step, from nodes to leaves,
has a row for each request, and its paths are not shuffled.

No task gets a language: leaves are numbered within ranges, and a task folds ``FAN ** LEVELS`` consecutive nodes at a time.

Rows without a doc_id come first in their language, and their text is never tampered with. Rows that repeat a doc_id are leaves of their own, in order of their leaf digests. All fields but
doc_id, source, lang, n_chars and text are ignored, whatever their names. An empty table has no root and no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbering import numbered
from plumbline.llm.common import ascii_lower, scratch_path, written

FAN = 8
#: Levels that one task folds: blocks of 512 nodes.
LEVELS = 3
#: One in so many rows is tampered with, told by the CRC-32 of the id.
TAMPERED = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(**changed: Column) -> Column:
    """H of the five fields of a row, some of them changed."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered, n, size): the digest of each row, that of its tampered form where it has one, its rank in its language's tree and that tree's leaves."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang")))  # no null, and in the order of the languages
    digests = docs.select(tree.alias("tree"), "doc_id", row_digest().alias("leaf"), F.when(chosen, row_digest(text=ascii_lower(F.col("text")))).alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    return numbered(written(digests, "digests"), ["tree"], ["doc_id", "leaf", "tie"], "n", "size").drop("tie")


def runs(nodes: Column) -> Column:
    """Every FAN consecutive nodes of an array."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda i: F.slice(nodes, i * FAN + 1, F.lit(FAN)))


def folded(rows: DataFrame) -> DataFrame:
    """(tree, n, size, l0..l3) of blocks of consecutive nodes (tree, n, digest, size): l0 the nodes, each further layer the H of the runs of the one below; null above a tree's top."""
    block = F.floor(F.col("n") / FAN**LEVELS)
    found = rows.groupBy("tree", block.alias("n"), "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "digest"))), lambda x: x["digest"]).alias("l0"))
    for k in range(LEVELS):
        above = F.transform(runs(F.col(f"l{k}")), lambda kids: F.sha2(F.array_join(kids, ""), 256))
        found = found.withColumn(f"l{k + 1}", F.when(F.col("size") > FAN**k, above))
    return found


def grown(nodes: DataFrame, name: str) -> tuple[DataFrame | None, DataFrame, int]:
    """(store, tops, height) of the trees over leaves (tree, n, digest, size): the records (height, digest, kids) of their nodes, (tree, top, size) of each tree, the largest height.

    The store is null where all trees are single leaves.
    """
    first = written(nodes, name)
    sizes = first.select("tree", "size").distinct().withColumnRenamed("size", "leaves")
    most = first.agg(F.max("size")).first()[0] or 0
    height = 0
    while FAN**height < most:
        height += 1
    records, now = [], first
    for low in range(0, height, LEVELS):
        layers = written(folded(now), f"{name}-layers")
        for k in range(LEVELS):
            each = layers.where(F.col(f"l{k + 1}").isNotNull()).select(F.lit(low + k + 1).alias("height"), F.explode(F.arrays_zip(F.col(f"l{k + 1}").alias("digest"), runs(F.col(f"l{k}")).alias("kids"))).alias("r"))
            records.append(each.select("height", "r.digest", "r.kids"))
        top = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)])
        now = layers.select("tree", "n", F.get(top, F.lit(0)).alias("digest"), F.ceil(F.col("size") / FAN**LEVELS).alias("size"))
    tops = written(now.select("tree", F.col("digest").alias("top")).join(sizes.hint("merge"), "tree").withColumnRenamed("leaves", "size"), f"{name}-tops")
    if not records:
        return None, tops, 0
    # equal nodes are one record; a folder for each height, so that a step of the descent reads its own
    path = scratch_path(nodes.sparkSession, f"{name}-store")
    reduce(DataFrame.unionByName, records).groupBy("height", "digest").agg(F.any_value("kids").alias("kids")).write.partitionBy("height").parquet(path)
    return nodes.sparkSession.read.schema("digest string, kids array<string>, height int").parquet(path), tops, height


def segment(kids: Column, place: Column) -> Column:
    """The children beside the selected one, as text before and behind it."""
    return F.struct(F.array_join(F.slice(kids, F.lit(1), place), "").alias("left"), F.array_join(F.slice(kids, place + 2, F.lit(FAN)), "").alias("right"))


def descended(starts: DataFrame, store: DataFrame | None, height: int, asked: DataFrame | None = None) -> DataFrame:
    """(tree, subroot, n, path, kids) of the lowest nodes on the ways to the leaves asked for, from ``starts(tree, subroot, size, path)``: kids are the leaves n * FAN and on;
    a tree of one leaf is its own lowest node, and its kids are null. ``asked(tree, n)``: all leaves if not given.
    """
    levels = F.lit(0)
    for k in range(height):
        levels = levels + (F.col("size") > FAN**k).cast("int")
    now = starts.select("tree", "subroot", F.col("subroot").alias("digest"), F.lit(0).cast("long").alias("n"), "path", levels.alias("height"))
    arrived = [now.where("height = 0").select("tree", "subroot", "n", "path", F.lit(None).cast("array<string>").alias("kids"))]
    for h in range(height, 0, -1):
        # trees of less height start at theirs
        here = written(now.where(F.col("height") <= h), "way")
        found = here.where(F.col("height") == h).join(store.where(F.col("height") == h).select("digest", "kids").hint("shuffle_hash"), "digest")
        if h == 1:
            arrived.append(found.select("tree", "subroot", "n", "path", "kids"))
            break
        below = found.select("tree", "subroot", "n", "path", "kids", F.posexplode("kids").alias("place", "digest"))
        below = below.select("tree", "subroot", "digest", (F.col("n") * FAN + F.col("place")).alias("n"), F.array_append("path", segment(F.col("kids"), F.col("place"))).alias("path"), F.lit(h - 1).alias("height"))
        if asked is not None:
            prefixes = asked.select("tree", F.floor(F.col("n") / FAN ** (h - 1)).alias("n")).distinct()
            below = below.join(prefixes.hint("shuffle_hash"), ["tree", "n"], "left_semi")
        now = below.unionByName(here.where(F.col("height") < h))
    return reduce(DataFrame.unionByName, arrived)


def path_root(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its reversed path lead to."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


NONE = "cast(array() as array<struct<left: string, right: string>>)"


def manifest(docs: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, leaf, subroot, root, path (from the leaf up: the siblings before and behind at each level), tampered (null where the row is not).

    ``requests(doc_id)``: only the rows of these ids (null among them asks for rows without one).
    """
    known = written(leaves(docs), "leaves")
    store, tops, height = grown(known.select("tree", "n", F.col("leaf").alias("digest"), "size"), "nodes")
    ranked = numbered(tops.select("tree", "top", F.col("size").alias("leaves")), [], ["tree"], "n", "size")
    ranked = written(ranked.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "n", "top", "leaves", "size"), "subroots")
    top_store, top, top_height = grown(ranked.select("tree", "n", F.col("top").alias("digest"), "size"), "top-nodes")
    root = top.first()
    if root is None:
        return docs.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root")], F.expr(NONE).alias("path"), F.lit(None).cast("string").alias("tampered")).where(F.lit(False))
    starts = top.select("tree", F.col("top").alias("subroot"), "size", F.expr(NONE).alias("path"))
    lowest = descended(starts, top_store, top_height).select("n", "path", F.posexplode_outer(F.coalesce("kids", F.array("subroot"))).alias("place", "digest"), "kids")
    way = F.when(F.col("kids").isNull(), F.col("path")).otherwise(F.array_append("path", segment(F.col("kids"), F.col("place"))))
    ways = lowest.select((F.col("n") * FAN + F.col("place")).alias("n"), way.alias("path"))
    starts = ranked.select("n", F.col("own").alias("tree"), F.col("top").alias("subroot"), F.col("leaves").alias("size")).join(ways.hint("shuffle_hash"), "n").select("tree", "subroot", "size", "path")

    wanted = known
    if requests is not None:
        ids = written(requests.select(F.col("doc_id").cast("long").alias("_id")).distinct(), "requests")
        wanted = written(known.join(ids.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi"), "wanted")
    lowest = descended(written(starts, "starts"), store, height, None if requests is None else wanted.select("tree", "n"))
    request = F.struct((F.col("n") % FAN).cast("int").alias("place"), "doc_id", "leaf", "tampered")
    groups = wanted.groupBy("tree", F.floor(F.col("n") / FAN).alias("n")).agg(F.collect_list(request).alias("requests"))
    met = lowest.join(groups.hint("shuffle_hash"), ["tree", "n"]).select("subroot", "path", "kids", F.explode("requests").alias("r"))
    way = F.when(F.col("kids").isNull(), F.col("path")).otherwise(F.array_append("path", segment(F.col("kids"), F.col("r.place"))))
    return met.select("r.doc_id", "r.leaf", "subroot", F.lit(root["top"]).alias("root"), F.reverse(way).alias("path"), "r.tampered")


def verified(proofs: DataFrame) -> DataFrame:
    """``manifest`` rows with proof_sha256 (H of all siblings), folded_root (what the tampered, else the original leaf leads to) and verified (whether that is the root)."""
    siblings = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    told = proofs.withColumns({"proof_sha256": siblings, "folded_root": path_root(F.col("path"), F.coalesce("tampered", "leaf"))})
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
