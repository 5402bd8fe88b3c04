"""Near duplicates among 64-bit fingerprints.

Equal fingerprints are one class, named by its smallest id: links are told between classes, and membership beside them, so that many copies make no pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import hamming

#: Pieces that make one key.
JOINED = 3


def keys(h: Column, distance: int) -> Column:
    """Keys such that two fingerprints within the distance share one: of ``distance`` + 3 pieces at least three are equal.

    At distance 3 these are 20 keys of 32 bits, so that unrelated fingerprints seldom meet, however many there are.
    """
    n = distance + JOINED
    edges = [64 * i // n for i in range(n + 1)]
    piece = [F.shiftrightunsigned(h, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    width = [b - a for a, b in zip(edges, edges[1:])]
    out = []
    for number, (i, j, k) in enumerate(combinations(range(n), JOINED)):
        joined = F.shiftleft(F.shiftleft(piece[i], width[j]).bitwiseOR(piece[j]), width[k]).bitwiseOR(piece[k])
        out.append(F.struct(F.lit(number).alias("kind"), joined.alias("piece")))
    return F.array(*out)


def classes(prints: DataFrame) -> DataFrame:
    """(rep, h) of each distinct fingerprint of ``prints(id, h)``, rep being its smallest id."""
    return prints.groupBy("h").agg(F.min("id").alias("rep"))


def members(prints: DataFrame) -> DataFrame:
    """(id, rep): the class of each row."""
    return prints.join(classes(prints).hint("shuffle_hash"), "h").select("id", "rep")


def probe(queries: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance) for the classes of two sides within the distance."""
    if distance == 0:
        return queries.select(F.col("rep").alias("a"), "h").join(known.select(F.col("rep").alias("b"), "h").hint("merge"), "h").select("a", "b", F.lit(0).alias("distance"))
    cut = lambda f, name: f.select(F.col("rep").alias(name), F.col("h").alias(f"h{name}"), F.inline(keys(F.col("h"), distance)))
    met = cut(queries, "a").join(cut(known, "b").hint("merge"), ["kind", "piece"]).select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance"))
    return met.where(F.col("distance") <= distance).distinct()


def near_duplicates(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance) of all pairs a < b of classes within the distance; copies are told by ``members``."""
    own = classes(prints)
    return probe(own, own, distance).where("a < b")


def prior_reports(requests: DataFrame, prints: DataFrame, distance: int = 0) -> DataFrame:
    """(a, b, distance): for each requested row the known classes that are equal, or within the distance."""
    met = probe(classes(requests), classes(prints), distance).withColumnRenamed("a", "rep")
    return members(requests).withColumnRenamed("id", "a").join(met.hint("merge"), "rep").select("a", "b", "distance")
