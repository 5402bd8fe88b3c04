"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A spaced seed is a fixed mask over consecutive tokens: its 1s are hashed, its 0s are ignored, so that a substituted token under
a 0 does not hide a copy. Every position of every text is hashed under every mask and looked up among the hashes of the
benchmark. Around each hit all aligned windows of ``window`` tokens that hold it are compared, the best counts: the text is
contaminated by the item if at least ``least`` of its tokens agree. Items shorter than the window are compared whole, at the same share of agreement; items shorter
than the shortest mask must occur in full.

Positions are exploded, hashed, looked up and verified inside one stage beside the text, so that no text and no hash is shuffled; only verified
(document, item) pairs are aggregated. The benchmark side is broadcast: for each seed where its items hold it, and their tokens once, in pieces. Its seeds are
counted first, and a benchmark with more than ``max_seeds`` is dealt by piece into as many blocks as keep each broadcast below that bound. Each block is a pass over
the texts; passes run one after another, so that one block's broadcasts stand at a time. A task holds a stretch of a text's hits at a time, with the tokens around them.

Null and empty texts and items match nothing. Items with equal texts are looked up once and reported each. Rows that repeat a doc_id are told apart by
their text; rows without an id are reported under a null id. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, words, written

#: Weight 6; together they find every alignment of WINDOW tokens with up to two substitutions, and 249 of 286 with three.
MASKS = ("111111", "1101011001", "1011000111")
WINDOW = 13
LEAST = 10
#: Seeds in one broadcast.
MAX_SEEDS = 500_000
#: Positions of a text or an item that are looked at in one go.
STRETCH = 4096


def picked(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def codes(text: Column) -> Column:
    """Each word's 64-bit hash: seeds are hashed from these, and words compared by them."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds_at(tokens: Column, at: Column, n: Column, masks: tuple[str, ...]) -> Column:
    """The seed hashes of position ``at`` (from 0), null where a mask passes the end."""
    return F.array(*[F.when(at + len(m) <= n, F.xxhash64(F.lit(k), *[F.get(tokens, at + i) for i in picked(m)])) for k, m in enumerate(masks)])


def entities(benchmark: DataFrame) -> DataFrame:
    """(entity, texts, items): items of equal texts are one entity, looked up and verified once. The texts are normal, words between single blanks; an item_id given to several texts has them all."""
    items = benchmark.select("item_id", F.array_join(words(F.col("text")), " ").alias("key")).where("key != ''")
    texts = items.groupBy("item_id").agg(F.sort_array(F.collect_set("key")).alias("texts"))
    return texts.groupBy("texts").agg(F.collect_list(F.struct("item_id")).alias("items")).select(F.xxhash64("texts").alias("entity"), "texts", "items")


def item_pieces(known: DataFrame, masks: tuple[str, ...], window: int) -> DataFrame:
    """(piece, entity, n, begins, lo, t): the texts' tokens in pieces of STRETCH positions from ``begins`` on, and around them what windows and masks there reach; ``lo`` is where ``t`` starts, n the whole text's length."""
    texts = known.select("entity", F.explode("texts").alias("key")).select("entity", "key", F.transform(F.split("key", " "), lambda w: F.xxhash64(w)).alias("all"))
    cut = texts.select("*", F.size("all").alias("n")).where(F.col("n") >= min(map(len, masks)))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STRETCH))).alias("begins"))
    cut = cut.withColumn("lo", F.greatest(F.lit(0), F.col("begins") - window + 1))
    reach = F.col("begins") + STRETCH + max(window, *map(len, masks)) - 1
    return cut.select(F.xxhash64("entity", "key", "begins").alias("piece"), "entity", "n", "begins", "lo", F.slice("all", F.col("lo") + 1, reach - F.col("lo")).alias("t"))


def around(at: Column, window: int) -> tuple[Column, Column, Column]:
    """Of position ``at`` of an item of n tokens: a window's length, where the windows that hold ``at`` start, and their tokens, of a piece's t."""
    compared = F.least(F.lit(window), F.col("n"))
    first = F.greatest(F.lit(0), at - compared + 1)
    return compared, first, F.slice("t", first - F.col("lo") + 1, F.least(F.col("n"), at + compared) - first)


def item_places(pieces: DataFrame, masks: tuple[str, ...], window: int) -> DataFrame:
    """(seed, piece, at): where in its pieces an entity holds a seed. Places with equal tokens in all windows around them count once."""
    at = pieces.select("*", F.explode(F.sequence("begins", F.least("n", F.col("begins") + STRETCH) - 1)).alias("at"))
    seeds = seeds_at(F.col("t"), F.col("at") - F.col("lo"), F.col("n") - F.col("lo"), masks)
    hashed = at.select("*", F.explode(seeds).alias("seed")).where("seed is not null")
    compared, first, tokens = around(F.col("at"), window)
    alike = hashed.groupBy("seed", "entity", (first - F.col("at")).alias("from_seed"), compared.alias("compared"), tokens.alias("tokens"))
    return alike.agg(F.min(F.struct("piece", "at")).alias("place")).select("seed", "place.*")


def short_items(known: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(entity, n, key) of texts too short for any mask."""
    texts = known.select("entity", F.explode("texts").alias("key"))
    return texts.select("entity", F.size(F.split("key", " ")).alias("n"), "key").where(F.col("n") < min(map(len, masks)))


def hits(docs: DataFrame, places: DataFrame, pieces: DataFrame, masks: tuple[str, ...], window: int, least: int) -> DataFrame:
    """(doc_id, text_hash, entity, agreed, compared) of each position that verifies.

    Spark's compiled loops hold all that one row coming in gives until it has given the last: those of a generator with a lambda are not compiled. So texts come in
    by stretches of positions, and what leaves the first join are a hit's window and its places, never the text's tokens; places are told apart after it, one hit at a time.
    """
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), codes(F.col("text")).alias("tokens"))
    # short texts have no positions; a filter on their length would split every text twice
    last = F.size("tokens") - min(map(len, masks))
    begins = F.filter(F.sequence(F.lit(0), last, F.lit(STRETCH)), lambda i: i <= last)
    part = tokens.select("*", F.explode(F.when(last >= 0, begins)).alias("begins"))
    at = part.select("*", F.explode(F.when(last >= 0, F.sequence("begins", F.least(last, F.col("begins") + STRETCH - 1)))).alias("at"))
    probes = at.select("*", F.explode(seeds_at(F.col("tokens"), F.col("at"), F.size("tokens"), masks)).alias("seed"))
    seeds = places.groupBy("seed").agg(F.collect_list(F.struct("piece", "at")).alias("places"))
    found = probes.join(F.broadcast(seeds), "seed")
    before = F.least(F.col("at"), F.lit(window - 1))
    near = found.select("doc_id", "text_hash", before.alias("before"), F.slice("tokens", F.col("at") - before + 1, F.lit(2 * window - 1)).alias("near"), "places")
    near = near.select("doc_id", "text_hash", "before", "near", F.explode(F.filter("places", lambda p: p["at"] >= 0)).alias("place"))
    met = near.select("doc_id", "text_hash", "before", "near", "place.*").join(F.broadcast(pieces), "piece")
    compared, first, item_tokens = around(F.col("at"), window)
    met = met.select("doc_id", "text_hash", "entity", "near", compared.alias("compared"), (F.col("before") + first - F.col("at")).alias("from_near"), item_tokens.alias("item_tokens"))
    # generators, not columns: the check must not move into the join, whose compiled loop would grow too large for the JIT
    at_window = lambda i: F.get("near", F.col("from_near") + i)
    same = F.filter(F.sequence(F.lit(0), F.size("item_tokens") - 1), lambda i: at_window(i) == F.get("item_tokens", i))
    close = met.select("doc_id", "text_hash", "entity", "compared", F.explode(F.array(same)).alias("same"))
    close = close.where(F.size("same") * window >= F.col("compared") * least)
    # a best window starts at a token that agrees, or ends with the tokens and holds no fewer than one that does
    agreed = F.array_max(F.transform("same", lambda s: F.size(F.filter("same", lambda i: (i >= s) & (i < s + F.col("compared"))))))
    checked = close.select("doc_id", "text_hash", "entity", "compared", F.explode(F.array(agreed)).alias("agreed"))
    return checked.where(F.col("agreed") * window >= F.col("compared") * least).select("doc_id", "text_hash", "entity", "agreed", "compared")


def short_hits(docs: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """The same for items that are shorter than any mask: all their tokens must agree."""
    longest = min(map(len, masks)) - 1
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens")).where("n > 0")
    at = tokens.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    grams = F.array(*[F.when(F.col("at") + k <= F.col("n"), F.array_join(F.slice("tokens", F.col("at") + 1, F.lit(k)), " ")) for k in range(1, longest + 1)])
    probes = at.select("doc_id", "text_hash", F.explode(grams).alias("key")).where("key is not null")
    return probes.join(F.broadcast(items), "key").select("doc_id", "text_hash", "entity", F.col("n").alias("agreed"), F.col("n").alias("compared"))


def by_entity(docs: DataFrame, known: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, least: int = LEAST, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(doc_id, text_hash, entity, hits, best): ``best`` is one number for the best window, so that the aggregate stays a hash aggregate: share of agreement, then tokens compared.

    Blocks of a large benchmark run one after another, each written, so that one broadcast stands at a time.
    """
    if not 1 <= window <= 255:
        raise ValueError("window must be from 1 to 255")
    key = ["doc_id", "text_hash", "entity"]
    pieces = item_pieces(known, masks, window)
    places = written(item_places(pieces, masks, window), "benchmark-seeds")
    blocks = max(1, -(-places.count() // max_seeds))
    own = lambda df, b: df.where(F.pmod("piece", F.lit(blocks)) == b) if blocks > 1 else df
    passes = [hits(docs, own(places, b), own(pieces, b).drop("begins"), masks, window, least) for b in range(blocks)]
    short = short_items(known, masks)
    n_short = short.count()
    few = max(1, -(-n_short // max_seeds))
    passes += [short_hits(docs, short.where(F.pmod(F.xxhash64("key"), F.lit(few)) == b), masks) for b in range(few if n_short else 0)]
    rank = F.floor(F.col("agreed") * 2.0**40 / F.col("compared")) * 256 + F.col("compared")
    summed = lambda df: df.groupBy(*key).agg(F.count("*").alias("hits"), F.max(rank).alias("best"))
    if max(blocks, few) == 1:
        return summed(reduce(DataFrame.unionByName, passes))
    found = reduce(DataFrame.unionByName, [written(summed(one), "benchmark-block") for one in passes])
    return found.groupBy(*key).agg(F.sum("hits").alias("hits"), F.max("best").alias("best"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, least: int = LEAST, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """One row a document and item that it holds a passage of: doc_id, text_hash (of its text), item_id, hits, agreed and compared tokens of the best window."""
    known = written(entities(benchmark), "benchmark-entities")
    best = by_entity(docs, known, masks, window, least, max_seeds)
    ids = known.select("entity", F.explode("items").alias("item")).select("entity", "item.item_id")
    best = best.join(F.broadcast(ids) if ids.count() <= max_seeds else ids, "entity")
    compared = F.col("best") % 256
    agreed = F.round(F.shiftright("best", 8) * compared / 2.0**40)
    return best.select("doc_id", "text_hash", "item_id", "hits", agreed.cast("int").alias("agreed"), compared.cast("int").alias("compared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs(doc_id, text, ...)`` without the contaminated documents."""
    doc, hash_ = fresh("_doc", docs.columns), fresh("_text_hash", docs.columns)
    found = by_entity(docs, written(entities(benchmark), "benchmark-entities"), **options).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left_anti")
