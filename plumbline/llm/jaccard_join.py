"""Exact self-join of documents whose word-shingle sets have a Jaccard similarity of ``share`` (4/5) or more.

Equal sets are one class, and the join is over classes; copies are never paired. Two sets A and B that link differ in at most
D = (q-p)(|A|+|B|) / (q+p) shingles for a similarity of p/q. Shingle hashes are dealt into m segments. Sets fall into size bands;
a set writes signatures for its own band, and for the next if a partner may lie there. By pigeonhole, segments whose
tolerances T add up so that sum(T+1) > D hold one that differs in at most T shingles:

* T = 0: m > D segments, one signature (the hash of the segment's subset) each;
* T = 1: half as many segments, each with its signature and those of its one-deletion neighbourhood.

``allocation`` weighs both by the signatures that they write and the segments that they leave empty, as the signature of an empty
segment is shared by unrelated sets. With T = 0 empty segments write nothing: a set whose other segments outnumber D is safe,
and a safe partner suffices. The few unsafe sets write one-deletion neighbourhoods and empty segments besides.

A set with s filled segments shares at least s - D of them with any partner: all but one of these are spare. So of its signatures
that more than ``HOT`` sets share, each set leaves out as many as it can spare, the most frequent first. All sets do so in the same
order (signatures that a sample shows to be shared by very many sets are ordered by its estimate, and their rows dealt to several tasks); hence of those that two partners share, the least frequent stays with both. What is left of hot signatures are large
groups of near copies, and sets that consist mostly of common passages: their sets are compared with the smallest id of the group first, and then only
across the components that result, where sketches of one byte a segment rule out nearly all pairs that cannot link. All candidate pairs are verified exactly on their whole texts.

Texts without a word have empty sets and link with nothing; with fewer words than a shingle has, the whole sequence is one. Rows that
repeat a doc_id are one document, linked as any of their texts is (its set size is the largest of theirs per row). Rows
without an id are one document with an id below all others, null in the result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import drop, handing_back, light_batches, written
from plumbline.llm.components import connected_components
from plumbline.llm.shingles import chunks, mix, shingle_sets

WORDS = 5
SHARE = (4, 5)
#: Sets of a signature that are paired with each other directly.
HOT = 8
#: Ids in a broadcast: 32 MB; beyond it, ids meet texts in a shuffle join.
BROADCAST_IDS = 2_000_000
NO_DOC = -(2**63)
#: Sets of a hot signature whose sketches are compared in one task: more are dealt into pairs of blocks.
BLOCK = 4_000
MAX_SKETCH = 4_096
#: Sets in which crowded signatures are looked for: one in so many; sets there that make a signature crowded; tasks among which its rows are dealt.
SAMPLED = 64
CROWD = 256
SALTS = 64
#: Cost of an empty segment, in signatures written.
EMPTY_COST = 200.0
STEP = 1.6


def differing(a: int, b: int, share: tuple[int, int]) -> int:
    p, q = share
    return (q - p) * (a + b) // (q + p)


@cache
def allocation(low: int, high: int, share: tuple[int, int]) -> tuple[int, int]:
    """(segments, tolerance) of the band of sizes low..high: the cheaper of both tolerances at its middle size."""
    d, size = differing(high, high, share), (low * high) ** 0.5
    exact, single = max(d + 2, 3 * high // 10 + 1), -(-(d + 1) // 2)
    empty = np.exp(-size / exact)
    unsafe = sum(comb(exact, k) * empty**k * (1 - empty) ** (exact - k) for k in range(exact - d, exact + 1)) if exact < 200 else 0.0
    costs = {0: exact + EMPTY_COST * unsafe, 1: single + size + EMPTY_COST * single * np.exp(-size / single)}
    tolerance = min(costs, key=costs.get)
    return (exact, 0) if tolerance == 0 else (single, 1)


@cache
def bands(upto: int, share: tuple[int, int]) -> tuple[list[int], np.ndarray]:
    """Largest sizes of the bands up to one that holds ``upto``: each at least the largest partner of the one before."""
    p, q = share
    out = [1]
    while out[-1] < upto:
        last = out[-1]
        out.append(max(last + 1, last * q // p, int(last * STEP) if last >= 64 else 0))
    return out, np.array(out)


def set_signatures(hashes: np.ndarray, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, int, int]]:
    """(signatures, band, spare segments) for each band that the set belongs to; none where only an equal set can link."""
    n, (p, q) = len(hashes), share
    most = n * q // p
    if differing(n, most, share) == 0:
        return
    tops, table = bands(2 * most, share)
    own = int(np.searchsorted(table, n))
    token = mix(hashes, 11)
    for band in (own, own + 1) if most > tops[own] else (own,):
        high = tops[band]
        m, tolerance = allocation(tops[band - 1] + 1 if band else 1, high, share)
        segment = (hashes % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        ordered = segment[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        filled = ordered[first]
        sums = np.add.reduceat(token[order], first)
        salt = mix(np.arange(m, dtype=np.uint64), 100 + band)
        with np.errstate(over="ignore"):
            keys = [mix(sums + salt[filled])]
            spare = len(filled) - differing(n, min(high, most), share) - 1
            if tolerance or spare < 0:
                spare = -1
                whole = np.zeros(m, np.uint64)
                whole[filled] = sums
                keys.append(mix(whole[segment] - token + salt[segment]))
                keys.append(mix(salt[np.setdiff1d(np.arange(m), filled)]))
        yield np.concatenate(keys), band, min(spare, 32_000)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, s1, s2) of each text: size of its set and two sums that tell sets apart."""
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = shingle_sets(part.column("text"), WORDS)
            sums = [pa.array([int(mix(s, k).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *sums], ["id", "n", "s1", "s2"])


def sign(share: tuple[int, int]):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, id, band, spare) of each signature."""
        for batch in batches:
            for part in chunks(batch, "text"):
                keys, ids, of_band, spares = [], [], [], []
                for i, s in zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), WORDS), strict=True):
                    for k, band, spare in set_signatures(s, share) if len(s) else ():
                        k = np.unique(k)
                        keys.append(k)
                        ids.append(np.full(len(k), i, np.int64))
                        of_band.append(np.full(len(k), band, np.int16))
                        spares.append(np.full(len(k), spare, np.int16))
                if keys:
                    columns = [np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(of_band), np.concatenate(spares)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "band", "spare"])

    return signatures


def sketch(share: tuple[int, int]):
    p, q = share

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, band, n, sketch): one byte for each of the band's segments, from the segment's subset of the set."""
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for i, of, s in zip(part.column("id").to_pylist(), part.column("bands").to_pylist(), shingle_sets(part.column("text"), WORDS), strict=True):
                    token = mix(s, 12)
                    for band in of if len(s) else ():
                        m = min(MAX_SKETCH, bands(2 * (len(s) * q // p), share)[0][band])
                        sums = np.zeros(m, np.uint64)
                        np.add.at(sums, (token % np.uint64(m)).astype(np.int64), token)
                        rows.append((i, band, len(s), (mix(sums) >> np.uint64(56)).astype(np.uint8).tobytes()))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int16(), pa.int32(), pa.binary()), strict=True)], ["id", "band", "n", "sketch"])

    return made


def nearby(share: tuple[int, int]):
    p, q = share

    def compared(key: tuple, rows: pa.Table) -> pa.Table:
        """(a, b) of the pairs of two blocks in different components whose sketches do not rule them out.

        Each segment that differs holds a shingle that only one of both sets has: more differing bytes than D, and no link.
        """
        i, j = key[1].as_py(), key[2].as_py()
        ids, component, n, own = (rows[c].to_numpy() for c in ("id", "component", "n", "own"))
        lines = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = [np.zeros((0, 2), np.int64)]
        for k in left:
            fits = right[(component[right] != component[k]) & (p * np.maximum(n[right], n[k]) <= q * np.minimum(n[right], n[k]))]
            fits = fits[ids[fits] > ids[k]] if i == j else fits
            differ = (lines[fits] != lines[k]).sum(1)
            fits = fits[differ <= (q - p) * (n[fits] + n[k]) // (q + p)]
            found.append(np.stack((np.minimum(ids[fits], ids[k]), np.maximum(ids[fits], ids[k])), 1))
        ab = np.concatenate(found)
        return pa.table({"a": ab[:, 0], "b": ab[:, 1]})

    return compared


def compare(share: tuple[int, int]):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) of the pairs whose sets reach the similarity; rows of one ``a`` come together, so that its set is made once."""
        p, q = share
        at, own = None, None
        for batch in batches:
            for part in chunks(batch, "text_b"):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                keep = []
                for i, (x, other) in enumerate(zip(a, shingle_sets(part.column("text_b"), WORDS), strict=True)):
                    text = part.column("text_a")[i]
                    if (x, len(str(text))) != at or own[1] != text:
                        own = (shingle_sets(pa.array([text.as_py()]), WORDS)[0], text)
                        at = (x, len(str(text)))
                    both = len(np.intersect1d(own[0], other, assume_unique=True))
                    keep.append(q * both >= p * (len(own[0]) + len(other) - both) and both > 0)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(b, pa.int64()).filter(mask)], ["a", "b"])

    return linked


def with_ids(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The semi or anti join of ``texts`` with a written table of ids: broadcast up to a bound, shuffled beyond."""
    few = ids.count() <= BROADCAST_IDS
    return texts.join(ids.hint("broadcast" if few else "shuffle_hash"), "id", how)


def verified(texts: DataFrame, pairs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The written edges (a, b) among the written candidate ``pairs``."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    known = with_ids(texts, ids, "left_semi")
    one, other = known.select(F.col("id").alias("a"), F.col("text").alias("text_a")), known.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(other.hint("shuffle_hash"), "b").join(one.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    with light_batches(texts.sparkSession):  # a row holds two texts
        edges = written(joined.mapInArrow(handing_back(compare(share)), "a long, b long").distinct(), "links")
    drop(ids)
    return edges


def crowded(texts: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(key, about) of signatures that very many sets share, with about how many; written.

    Found on one in ``SAMPLED`` sets. This only decides where their rows are counted: rows of such a signature are dealt to ``SALTS`` tasks and take the estimate as
    their count, which serves as well, as counts only order the hot signatures, alike for all sets. No row is left out. A signature told here has ``CROWD`` sets in the
    sample, so that the table has at most one row for each ``CROWD`` signatures of the sample; where these are too many to broadcast, they meet the signatures in a shuffle join.
    """
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).mapInArrow(handing_back(sign(share)), "key long, id long, band short, spare short")
    found = some.groupBy("key").agg((F.count("*") * SAMPLED).alias("about")).where(F.col("about") >= CROWD * SAMPLED)
    return written(found, "crowded")


def group_pairs(shared: DataFrame) -> DataFrame:
    """All pairs of the sets of signatures that at most HOT sets share."""
    sets = shared.where(F.col("cnt") <= HOT).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    nested = "flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))"
    return sets.where(F.size("ids") > 1).select(F.explode(F.expr(nested)).alias("p")).select("p.a", "p.b").distinct()


def shingle_links(docs: DataFrame, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """(sets, edges): (id, n, rep) of each row, rep being the smallest id with an equal set; and the links (a, b) that
    join the same classes as all links do. Both are written."""
    with light_batches(docs.sparkSession, rows=1000):  # whole texts pass the workers
        return links_of(docs, share)


def links_of(docs: DataFrame, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    described = written(texts.mapInArrow(handing_back(describe), "id long, n long, s1 long, s2 long"), "sets")
    # only classes of several rows are joined; written first, so that a class with a large share of all rows is split (AQE splits joins of plain shuffles)
    classes = described.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    classes = written(classes, "equal-sets")
    sets = described.join(classes.hint("shuffle_hash"), ["n", "s1", "s2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    sets = written(sets, "classes")
    drop(described, classes)
    # ids none of whose rows stands for its class
    copies = written(sets.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < id and high < id").select("id"), "copies")
    own = with_ids(texts, copies, "left_anti")
    hottest = crowded(own, share)
    keys = own.mapInArrow(handing_back(sign(share)), "key long, id long, band short, spare short").join(hottest.hint("broadcast" if hottest.count() <= BROADCAST_IDS else "merge"), "key", "left")
    salt = F.when(F.col("about").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)
    counted = keys.withColumn("salt", salt).withColumn("cnt", F.coalesce("about", F.count("*").over(Window.partitionBy("key", "salt")))).drop("salt", "about")
    shared = written(counted.where("cnt > 1"), "signatures")
    drop(copies, hottest)

    # each set leaves out as many of its hottest signatures as it can spare
    by_count = Window.partitionBy("id", "band").orderBy(F.desc("cnt"), "key")
    hot = shared.where(F.col("cnt") > HOT).withColumn("n", F.row_number().over(by_count)).where("n > spare")
    hot = written(hot.select("key", "id", "band").distinct(), "hot")
    hubs = written(hot.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("cnt")).where("cnt > 1"), "hubs")
    spokes = hot.join(hubs.hint("merge"), "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = written(group_pairs(shared).unionByName(spokes).distinct(), "pairs")
    drop(shared, hubs)
    edges = verified(texts, pairs, share)

    # what the hubs left apart: sets of one hot signature in different components, by block pairs of their sketches
    component = connected_components(edges)
    placed = hot.join(component.hint("shuffle_hash"), "id", "left").select("key", "id", "band", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "placed")
    drop(hot, component)
    torn = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("hub"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high")
    torn = written(torn, "torn")
    open_ = written(placed.join(torn.hint("shuffle_hash"), "key").where("id <> hub").select("key", "id", "band", "component", "blocks"), "open")
    drop(placed, torn)
    asked = written(open_.groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("bands")), "asked")
    few = asked.count() <= BROADCAST_IDS
    sketches = texts.join(asked.hint("broadcast" if few else "shuffle_hash"), "id").mapInArrow(handing_back(sketch(share)), "id long, band short, n int, sketch binary")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", "band", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.join(sketches.hint("shuffle_hash"), ["id", "band"])
    across = dealt.groupBy("key", "i", "j").applyInArrow(nearby(share), "a long, b long").distinct()
    across = written(across.join(pairs.hint("shuffle_hash"), ["a", "b"], "left_anti"), "across")
    drop(pairs, open_, asked)
    if across.isEmpty():
        return sets, edges
    more = verified(texts, across, share)
    drop(across)
    return sets, edges.unionByName(more)


def jaccard_components(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row a row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    sets, edges = shingle_links(docs, share)
    # rows that repeat an id tie all classes of its texts to it
    several = written(sets.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id"), "several-classes")
    ties = sets.join(several.hint("shuffle_hash"), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    component = connected_components(edges.unionByName(ties))
    joined = sets.join(component.withColumnRenamed("id", "rep").hint("shuffle_hash"), "rep", "left")
    back = lambda c: F.when(c != NO_DOC, c)
    return joined.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component", "rep")).alias("component_id"))
