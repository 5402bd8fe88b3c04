"""Spelling variants among the words of a corpus, by blocked Gram matrices of letter counts.

Words are maximal runs of letters, A-Z lower-cased, of at least ``min_chars`` code points and ``min_count`` occurrences. To have something to find, the runs are
first misspelt: where ``every`` divides h, the CRC-32 of ``<doc_id>:<run>``, the run loses its code point number h % length.

Two words are *near* if they differ by one inserted, deleted or replaced code point. Then their letter counts differ by a squared distance of 1 (lengths differ by
one) or 2 (same length). Words are dealt into buckets by length and by the number of their letters of each of ``CLASSES`` classes; one edit leads to a bucket
of the same or the next length in which one class has a letter more, or one has a letter more and another one less, so only such buckets meet. A bucket is cut into blocks of
bounded size. For two blocks, a matrix product of letter counts gives all squared distances at once; the pairs at the distance that an edit makes are
verified letter by letter. A task holds two blocks at a time and hands on one row a word: how many near words it has there, and the one that occurs most.

A word's form is its near word of most occurrences (ties: the smallest in code-point order), if it occurs at least ``ratio`` times as often; its root is where forms lead to.

Null texts have no words; a null doc_id counts as an empty one. Rows that repeat an id or a text count each. Extra columns are ignored, whatever their names. Words of any length take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, light_batches, written

MIN_CHARS = 6
MIN_COUNT = 5
EVERY = 199
RATIO = 5
#: Classes of letters by code point.
CLASSES = 5
#: Words and letters of a block at most (one word, however long, is a block).
BLOCK = 2_048
BLOCK_LETTERS = 2_000_000
#: Sizes of buckets with several blocks that are broadcast at most.
FEW = 100_000
#: The letters, all below U+0100 once A-Z are lower-cased.
LETTERS = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]
AT = np.zeros(256, np.int64)
AT[[ord(x) for x in LETTERS]] = np.arange(len(LETTERS))
SUMMARY = "word string, n_near long, near string, near_n long"


def misspelt(doc_id: Column, run: Column, every: int = EVERY) -> Column:
    """The lower-cased run, or what is left of it where ``every`` divides its hash."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of the words of ``docs(doc_id, text)``."""
    # runs only get shorter, so shorter ones need no look
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{max(1, min_chars)},}}"), F.lit(0))).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), ascii_lower(F.col("run")), every).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bucket(length: Column, counts: list[Column]) -> Column:
    return F.concat_ws(":", length.cast("string"), *[c.cast("string") for c in counts])


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(own, length, c0.., block, words, ns): words of one length and the same counts of letters of each class, at most about ``block`` of them, joined by spaces."""
    length = F.length("word")
    classes = [length - F.length(F.translate("word", "".join(x for x in LETTERS if ord(x) % CLASSES == k), "")) for k in range(CLASSES)]
    names = [f"c{k}" for k in range(CLASSES)]
    placed = words.select("word", "n", length.alias("length"), *[c.alias(name) for name, c in zip(names, classes, strict=True)])
    placed = placed.withColumn("own", bucket(F.col("length"), [F.col(c) for c in names]))
    fit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    sizes = placed.groupBy("own", "length").count().where(F.col("count") > fit).select("own", F.ceil(F.col("count") / fit).alias("parts"))
    sizes = written(sizes, "bucket-sizes")
    dealt = placed.join(sizes.hint("broadcast" if sizes.count() <= FEW else "shuffle_hash"), "own", "left")
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).alias("block")
    rows = dealt.groupBy("own", "length", *names, part).agg(F.collect_list(F.struct("word", "n")).alias("w"))
    return rows.select("own", "length", *names, "block", F.array_join(F.col("w")["word"], " ").alias("words"), F.col("w")["n"].alias("ns"))


def partners(length: Column, counts: list[Column]) -> Column:
    """Each bucket that an edit leads to, of every two such buckets from one of them only: the next length, and the same length."""
    moved = lambda change: [c + change.get(k, 0) for k, c in enumerate(counts)]
    longer = [bucket(length + 1, moved({k: 1})) for k in range(len(counts))]
    replaced = [bucket(length, moved({i: 1, j: -1})) for i in range(len(counts)) for j in range(i + 1, len(counts))]
    return F.array(bucket(length, counts), *longer, *replaced)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    out, rows = np.zeros((len(codes), len(LETTERS)), np.float32), np.arange(len(codes))
    for column in AT[codes].T:
        out[rows, column] += 1
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` becomes that of ``b`` by one replacement (same width) or one insertion (``b`` wider by one)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return before + behind >= a.shape[1]


def near_rows(a: np.ndarray, b: np.ndarray, same: bool, step: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the near rows of two blocks of words, as letter codes; of one block each pair once."""
    distance = 2 if a.shape[1] == b.shape[1] else 1
    x, y = letter_counts(a), letter_counts(b)
    used = x.any(0) & y.any(0)
    left, right = x[:, used], y[:, used].T.copy()
    # |x|^2 + |y|^2 - 2xy = distance
    half_x, half_y = ((x * x).sum(1) - distance) / 2, (y * y).sum(1) / 2
    found = []
    for k in range(0, len(a), step):
        gram = left[k : k + step] @ right
        gram -= half_x[k : k + step, None]
        gram -= half_y
        i, j = np.nonzero(gram == 0)
        i += k
        keep = i < j if same else slice(None)
        found.append(np.stack((i[keep], j[keep])))
    i, j = np.concatenate(found, axis=1)
    keep = [one_edit(a[i[k : k + 500_000]], b[j[k : k + 500_000]]) for k in range(0, len(i), 500_000)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def summary(own: np.ndarray, others: np.ndarray, words: list[str], other_words: list[str], other_n: np.ndarray) -> list[tuple]:
    """(word, n_near, near, near_n) of the words with near ones, from the pairs (own, others)."""
    if not len(own):
        return []
    best = np.lexsort((np.array(other_words), -other_n))
    rank = np.empty(len(best), np.int64)
    rank[best] = np.arange(len(best))
    order = np.lexsort((rank[others], own))
    who, first, n = np.unique(own[order], return_index=True, return_counts=True)
    near = others[order][first]
    return [(words[w], int(k), other_words[m], int(other_n[m])) for w, k, m in zip(who, n, near, strict=True)]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = lambda text: np.frombuffer((text + " ").encode("latin-1"), np.uint8).reshape(-1, text.find(" ") + 1 or len(text) + 1)[:, :-1]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            same = r["words"] == r["other_words"]
            i, j = near_rows(codes(r["words"]), codes(r["other_words"]), same)
            if len(i):
                a, b, n, m = r["words"].split(" "), r["other_words"].split(" "), np.array(r["ns"]), np.array(r["other_ns"])
                if same:
                    i, j = np.concatenate((i, j)), np.concatenate((j, i))
                else:
                    rows += summary(j, i, b, a, n)
                rows += summary(i, j, a, b, m)
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "near", "near_n"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) that have near ones: how many, and the one of most occurrences."""
    cut = written(blocks(words, block), "word-blocks")
    names = [f"c{k}" for k in range(CLASSES)]
    asks = cut.select("own", F.col("block").alias("block_a"), "words", "ns", F.explode(partners(F.col("length"), [F.col(c) for c in names])).alias("other"))
    gives = cut.select(F.col("own").alias("other"), F.col("block").alias("block_b"), F.col("words").alias("other_words"), F.col("ns").alias("other_ns"))
    met = asks.join(gives.hint("merge"), "other").where((F.col("own") != F.col("other")) | (F.col("block_a") <= F.col("block_b")))
    found = met.select("words", "ns", "other_words", "other_ns").mapInArrow(compare, SUMMARY)
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), "near"))
    with light_batches(words.sparkSession, rows=200):  # a row holds two blocks
        return written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", "b.near_n"), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from ``forms(word, form)``: the way doubles with each written round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return now
        now = step.select("word", "root")


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs(doc_id, text, ...)``."""
    words = written(word_counts(docs, min_chars, min_count, every), "words")
    near = near_words(words, block)
    told = words.join(near.hint("shuffle_hash"), "word", "left")
    has = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    told = told.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near_n")).alias("form_n"))
    told = written(told, "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends.hint("shuffle_hash"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
