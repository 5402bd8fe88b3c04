"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits, in DataFrame expressions only.

Each distinct five-word shingle is hashed once; the hash's top bits name its bin, and a bin keeps its least hash. An empty bin borrows
from the first filled bin in an order of its own: a few probes drawn by hash, then all filled bins by a hash of both. As the order
depends on the bin alone, equal choices meet equal bins, and borrowed bins match with the probability of filled ones. Of each bin's hash the
low ``BITS`` bits are stored. Two unrelated bins agree in them with probability c = 2**-BITS; likeness corrects for it: (matches - c) / (1 - c),
within 0 and 1.

Texts of fewer than five words have their whole sequence as one shingle. Null, empty and blank texts have no shingle and
the fingerprint of zeros of that length, marked by a leading ``-``; such are alike (1) among each other and unlike (0) all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shuffle_partitions, words

WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
PROBES = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """The hash of each shingle in order, repeated where shingles are."""

    def of(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        return F.when(n >= WORDS, grams).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(words(text), of)


REST = 64 - BIN_BITS
FULL = (1 << REST) - 1


def numbers(xs) -> Column:
    """A literal array; unlike a transformed sequence it is folded once, not made anew for each element that asks for it."""
    return F.array(*[F.lit(x) for x in xs])


def ends() -> Column:
    """The greatest hash of each bin: marks it as empty where no hash is smaller. Bins follow the signed order of hashes."""
    return numbers([((b - BINS // 2) << REST) + FULL for b in range(BINS)])


def bin_minima(hashes: Column) -> Column:
    """The least value of each bin, the marks included: always BINS values, by bin."""
    ordered = F.sort_array(F.concat(hashes, ends()))
    top = lambda x: F.shiftright(x, REST)
    return let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1)))))


def probe_table() -> Column:
    """The first probes of each bin, by a multiplicative rule."""
    return F.array(*[numbers([((b * PROBES + t + 1) * 0x9E3779B97F4A7C15 % 2**64) >> REST for t in range(PROBES)]) for b in range(BINS)])


def densified(minima: Column) -> Column:
    """The low bits of each bin's value; empty bins borrow theirs. Null where all bins are empty."""

    def of(m: Column) -> Column:
        empty = lambda i: F.get(m, i).bitwiseAND(F.lit(FULL)) == FULL
        filled = F.filter(numbers(range(BINS)), lambda i: ~empty(i))

        def chosen(i: Column, f: Column) -> Column:
            probed = F.get(F.filter(F.get(probe_table(), i), lambda j: ~empty(j)), F.lit(0))
            nearest = F.array_min(F.transform(f, lambda j: F.struct(F.xxhash64(i, j), j.alias("j"))))["j"]
            return F.coalesce(probed, nearest)

        low = lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int")
        # what is borrowed is hashed with the borrower, so that few shingles still give independent bits
        bits = lambda i, f: F.when(~empty(i), low(F.get(m, i))).otherwise(low(F.xxhash64(F.get(m, chosen(i, f)), i)))
        borrow = lambda f: F.transform(numbers(range(BINS)), lambda i: bits(i, f))
        return let(filled, lambda f: F.when(F.size(f) > 0, borrow(f)))

    return let(minima, of)


def packed(bins: Column) -> Column:
    """The bins as text: two hex digits each, or the mark of an empty set."""
    digits = BITS // 4
    text = F.array_join(F.transform(bins, lambda b: F.lpad(F.lower(F.hex(b)), digits, "0")), "")
    return F.coalesce(text, F.lit("-" + "0" * (BINS * digits)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two arrays of bins; null stands for the empty set."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / BINS
    chance = 2.0**-BITS
    fixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(fixed)


def fingerprint_bins(text: Column) -> Column:
    return densified(bin_minima(shingle_hashes(text)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``docs(doc_id, text)`` with ``bins``, ``next_text`` and ``next_bins`` of the row that follows by doc_id (nulls first, then text); after the last, the first.

    Ranges of doc_id between approximate quantiles are ordered each in its own task. The first row of each range is
    copied to the end of the range before, so that no row of a range needs another. Texts are hashed behind the shuffle, which carries no bins.
    """
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda xs: F.array(*[F.lit(int(x)) for x in xs]) if xs else F.expr("cast(array() as array<bigint>)")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    # two levels: first among every step-th bound, then within the step
    coarse = bounds[step - 1 :: step]
    fine = F.slice(literal(bounds), F.col("_coarse") * step + 1, F.lit(step))
    ranged = docs.withColumn("_coarse", below(literal(coarse))).withColumn("_range", F.col("_coarse") * step + below(fine)).drop("_coarse")

    firsts = ranged.groupBy("_range").agg(F.min("doc_id").alias("_first"), F.max(F.col("doc_id").isNull()).alias("_null"))
    firsts = firsts.select("_range", F.when(~F.col("_null"), F.col("_first")).alias("_first"))  # at most one row a range
    before = Window.orderBy("_range")
    last = F.max("_range").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("_first", F.coalesce(F.lag("_range").over(before), last).alias("_before"))
    heads = ranged.join(F.broadcast(firsts), ranged["doc_id"].eqNullSafe(firsts["_first"])).groupBy("_before").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("_before").alias("_range"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("_copy"))
    both = ranged.select("_range", F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("_copy")).unionByName(heads)
    both = both.repartition("_range").withColumn("bins", fingerprint_bins(F.col("text")))
    order = Window.partitionBy("_range").orderBy("_copy", F.asc_nulls_first("doc_id"), "text")
    led = both.select("_copy", "doc_id", "text", "bins", F.lead("text").over(order).alias("next_text"), F.lead("bins").over(order).alias("next_bins"))
    return led.where("_copy = 0").drop("_copy")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)``: doc_id, text and edited text (its last quarter replaced by the start of the next
    document), the bins of both, and their likeness to each other and of the text to the next document's.

    Null texts are empty. Rows that repeat an id follow each other by text; a table of one row is followed by itself. Extra columns are ignored.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(own, 4 * shuffle_partitions(docs.sparkSession))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    led = led.withColumn("edited", edited).withColumn("edited_bins", fingerprint_bins(F.col("edited")))
    return led.select("doc_id", "text", "edited", "bins", "edited_bins", likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
