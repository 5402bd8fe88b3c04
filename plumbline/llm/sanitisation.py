"""Information-theoretic sanitisation of personal data. Expressions only.

*Protected entities* are what patterns find: email and network addresses, card and phone numbers. *Terms* (words of ``TERM``, lower-cased) that stand among the
``WINDOW`` words before or behind a mention co-occur with its entity. Over the distinct texts of the corpus, p(t), p(e) and p(t, e) are the shares of texts with the term, with
the entity, and with the term beside the entity. A term discloses the entity by its pointwise mutual information, log p(t, e) / (p(t) p(e)); the entity itself holds
-log p(e). A term that gives away ``share`` of this or more, seen in at least ``support`` different windows, is sensitive wherever it occurs. It is *generalised* to its
class (name, word, number, code) if the class, counted alike, stays below that share for all entities that the term discloses; else it is *removed*.

Spans of the patterns stay as they are; sensitive terms add spans of the kinds ``generalise`` and ``remove`` where they do not overlap one. Copies of a text count once; copies of a
window are one window. Texts and windows are told apart by 64-bit hashes.

Null texts are empty. Rows that repeat an id or a text each have a result of their own. Rows without an id are scanned like others. Extra columns pass through, but for those that have the name
of a result (in any case), which the result replaces. Spans and windows are found in time about linear in a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, written

#: Characters of the local part of an address; a run of them is tried from its start, or where the last match ended.
LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, with possessive repeats (they match the same, and no long run is tried twice).
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "generalise", "remove")
BASE = len(PATTERNS)
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CARD, PHONE = (12, 19), (9, 15)
#: Terms, and what stands for no term beside a mention: addresses and long numbers.
TERM = r"[\p{L}\p{N}]{3,}"
NO_TERM = r"\S*@\S*|\+?[0-9][0-9 ().-]{6,}"
#: Classes of terms, and what tells that a text has a term of the class.
CLASSES = {"number": r"(?<![\p{L}\p{N}])\p{N}++(?!\p{L})", "code": r"\p{L}\p{N}|\p{N}\p{L}", "name": r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*+(?!\p{N})", "word": r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"}
#: Words, and code points, before and behind a mention.
WINDOW, REACH = 8, 160
SUPPORT = 3
SHARE = 0.9
#: Matches whose places are summed at a time; code points of a piece of a text.
CHUNK, PIECE = 128, 4_096
#: Terms are counted in one of so many texts first: what is too common there is so in all.
FIRST = 16
#: Terms, or ids of texts, that are broadcast at most.
FEW_TERMS, FEW_TEXTS = 100_000, 1_000_000
SPAN = "struct<start: bigint, end: bigint, value: string>"


def chunks(items: Column, size: int = CHUNK) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / size)).cast("int"))
    return F.transform(starts, lambda i: F.slice(items, i * size + 1, F.lit(size)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value), end exclusive, in code points.

    The gaps between matches and the matches give the places; they are summed within chunks, then over chunks.
    """
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        own = F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))))
        return F.struct(end.alias("at"), own.alias("spans"))

    def placed(summed: Column) -> Column:
        firsts = F.aggregate(summed, F.expr("struct(cast(0 as bigint) as at, cast(array() as array<bigint>) as out)"), lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
        return F.flatten(F.zip_with(summed, firsts, lambda c, first: F.transform(c["spans"], lambda s: F.struct((s["start"] + first).alias("start"), (s["end"] + first).alias("end"), s["value"].alias("value")))))

    def spans(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        steps = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) > 0, let(let(steps, lambda x: F.transform(chunks(x), lambda c: F.aggregate(c, zero, step))), placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def entity(kind: str, value: Column) -> Column:
    """The match as one of its kind is known by, or null where it is none."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lower(value)
    if kind == "ip":
        return F.when(value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), value)
    low, high = CARD if kind == "card" else PHONE
    fits = F.length(digits).between(low, high)
    return F.when(fits, F.when(luhn(digits), digits)) if kind == "card" else F.when(fits, digits)


def base_spans(text: Column) -> Column:
    """The spans of the patterns by start, then kind: array of (start, kind, end, entity hash)."""

    def of_kind(k: int, kind: str) -> Column:
        known = F.transform(matches(text, PATTERNS[kind]), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), entity(kind, m["value"]).alias("entity")))
        valid = F.filter(known, lambda m: m["entity"].isNotNull())
        there = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        hashed = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.xxhash64(m["kind"], m["entity"]).alias("entity")))
        return F.when(there, hashed).otherwise(F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint, entity: bigint>>)"))

    return F.array_sort(F.concat(*[of_kind(k, kind) for k, kind in enumerate(PATTERNS)]))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, length: Column) -> Column:
    """``length`` (at most PIECE) code points of a text in pieces, from ``start``."""
    k = F.floor(start / PIECE).cast("int")
    return F.substring(F.concat(F.coalesce(F.get(cut, k), F.lit("")), F.coalesce(F.get(cut, k + 1), F.lit(""))), (start - k * PIECE + 1).cast("int"), length.cast("int"))


def windows(cut: Column, spans: Column) -> Column:
    """For each span: entity, the terms among the words beside it as they are written, and a hash that tells windows apart."""

    def window(s: Column) -> Column:
        from_ = F.greatest(F.lit(0).cast("long"), s["start"] - REACH)
        sides = between(cut, from_, s["start"] - from_), between(cut, s["end"], F.lit(REACH))
        terms = [F.regexp_extract_all(F.regexp_replace(x, NO_TERM, " "), F.lit(TERM), F.lit(0)) for x in sides]
        before, behind = F.slice(F.reverse(terms[0]), F.lit(1), F.lit(WINDOW)), F.slice(terms[1], F.lit(1), F.lit(WINDOW))
        return F.struct(s["entity"].alias("entity"), F.array_distinct(F.concat(before, behind)).alias("terms"), F.xxhash64(F.concat(before, behind)).alias("window"))

    return F.transform(spans, window)


def class_of(term: Column) -> Column:
    digit = term.rlike(r"\p{N}")
    return F.when(digit, F.when(term.rlike(r"\p{L}"), "code").otherwise("number")).when(term.rlike(r"^\p{Lu}"), "name").otherwise("word")


def scanned(docs: DataFrame, own: str) -> DataFrame:
    """(own, text_hash, base, near) of each row of ``docs(text, own)``; written, without the text."""
    text = F.coalesce("text", F.lit(""))
    has = docs.select(own, text.alias("text"), F.xxhash64(text).alias("text_hash"), *[text.rlike(p).alias(f"has_{c}") for c, p in CLASSES.items()])
    found = has.withColumn("base", base_spans(F.col("text")))
    none = F.expr("cast(array() as array<struct<entity: bigint, terms: array<string>, window: bigint>>)")
    near = F.when(F.size("base") > 0, let(pieces(F.col("text")), lambda cut: windows(cut, F.col("base")))).otherwise(none)
    return written(found.select(own, "text_hash", *[f"has_{c}" for c in CLASSES], "base", near.alias("near")), "protected")


def few(table: DataFrame, most: int) -> DataFrame:
    """A written table for a join: broadcast up to ``most`` rows, shuffled beyond."""
    return table.hint("broadcast" if table.count() <= most else "shuffle_hash")


def text_terms(docs: DataFrame) -> DataFrame:
    """(text_hash, term) of the distinct terms of each text."""
    text = F.coalesce("text", F.lit(""))
    # the hash before the explosion: beside it, it would be worked out for each term
    cut = docs.select(F.xxhash64(text).alias("text_hash"), F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("terms"))
    return cut.select("text_hash", F.explode("terms").alias("term"))


def sensitive_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame | None:
    """The written terms (term, class, removed) that disclose a protected entity of ``found``; None where no term has the support."""
    mentions = found.where(F.size("near") > 0).select("text_hash", F.explode("near").alias("m")).select("text_hash", "m.*")
    mentions = mentions.groupBy("text_hash", "entity", "window").agg(F.any_value("terms").alias("terms"))
    entities = mentions.groupBy("entity").agg(F.count_distinct("text_hash").alias("texts_e"), F.count_distinct("window").alias("windows")).where(F.col("windows") >= support)
    entities = written(entities.select("entity", "texts_e"), "entities")
    seen = written(mentions.join(few(entities, FEW_TERMS), "entity"), "mentions")
    spelt = seen.select("text_hash", "entity", "texts_e", "window", F.explode("terms").alias("as_written"))
    beside = spelt.groupBy("entity", "texts_e", F.lower("as_written").alias("term")).agg(
        F.count_distinct("text_hash").alias("texts_te"), F.count_distinct("window").alias("windows"), F.min(class_of(F.col("as_written"))).alias("class"))
    beside = written(beside.where(F.col("windows") >= support), "beside")
    if beside.isEmpty():
        return None
    texts = found.groupBy("text_hash").agg(*[F.any_value(f"has_{c}").cast("int").alias(c) for c in CLASSES]).agg(F.count("*").alias("all"), *[F.sum(c).alias(c) for c in CLASSES]).first()
    # a term in more texts than this discloses nothing: those seen in as many beside any mention, or in a part of the texts, need no count over all of them
    most = F.col("texts_te") * F.pow(F.lit(float(texts["all"])) / F.col("texts_e"), F.lit(1 - share)) * (1 + 1e-6)
    asked = beside.groupBy("term").agg(F.max(most).alias("most"))
    anywhere = mentions.select("text_hash", F.explode("terms").alias("t")).select("text_hash", F.lower("t").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("least"))
    asked = written(asked.join(anywhere.hint("shuffle_hash"), "term").where("least <= most").select("term", "most"), "asked-terms")
    part = text_terms(docs.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FIRST)) == 0))
    seen_in_part = part.join(few(asked, FEW_TERMS), "term").distinct().groupBy("term", "most").agg(F.count("*").alias("least")).where("least > most").select("term")
    asked = written(asked.join(seen_in_part.hint("shuffle_hash"), "term", "left_anti").select("term"), "rarer-terms")
    told = text_terms(docs).join(few(asked, FEW_TERMS), "term").distinct().groupBy("term").agg(F.count("*").alias("texts_t"))
    told = written(told, "term-texts")
    beside_class = spelt.groupBy("entity", class_of(F.col("as_written")).alias("class")).agg(F.count_distinct("text_hash").alias("texts_ce"))
    all_ = F.lit(float(texts["all"]))
    of_class = F.coalesce(*[F.when(F.col("class") == c, F.lit(float(texts[c] or 0))) for c in CLASSES])
    held = F.log(all_ / F.col("texts_e"))
    disclosed = lambda both, alone: F.log(all_ * both / (alone * F.col("texts_e"))) >= share * held - 1e-9
    pairs = beside.join(told.hint("shuffle_hash"), "term").where((held > 0) & disclosed(F.col("texts_te"), F.col("texts_t")))
    pairs = pairs.join(written(beside_class, "beside-classes").hint("shuffle_hash"), ["entity", "class"], "left")
    removed = F.coalesce(disclosed(F.col("texts_ce"), of_class), F.lit(False))
    return written(pairs.groupBy("term").agg(F.min("class").alias("class"), F.max(removed).alias("removed")), "sensitive")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_hash, added) of the texts with sensitive ``terms``: all their places, as (start, kind, end, class)."""
    terms = few(terms, FEW_TERMS)
    texts = written(text_terms(docs).join(terms, "term", "left_semi").select("text_hash").distinct(), "asked-texts")
    text = F.coalesce("text", F.lit(""))
    asked = docs.select(text.alias("text"), F.xxhash64(text).alias("text_hash")).join(few(texts, FEW_TEXTS), "text_hash", "left_semi")
    places = asked.select("text_hash", F.explode(matches(F.col("text"), TERM)).alias("m")).select("text_hash", "m.start", "m.end", F.lower("m.value").alias("term"))
    kind = F.when(F.col("removed"), BASE + 1).otherwise(BASE)
    met = places.join(terms, "term").select("text_hash", F.struct("start", kind.alias("kind"), "end", "class").alias("s"))
    return written(met.groupBy("text_hash").agg(F.collect_set("s").alias("added")), "term-spans")


def sanitisation(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``docs(text, ...)`` without the text, with n_email, n_ip, n_card, n_phone (long), base_sha256 and ``spans``: structs of kind, start, end, class by start, then kind.

    ``class`` is what a generalised or removed term is; null for the patterns' spans.
    """
    results = {"text", "spans", "base_sha256", *[f"n_{k}" for k in PATTERNS]}
    others = [c for c in docs.columns if c.lower() not in results]
    own = fresh("own", [*docs.columns, "text_hash", "base", "near", "added"])
    packed = docs.select("text", F.struct(*others).alias(own) if others else F.lit(None).cast("int").alias(own))
    found = scanned(packed, own)
    terms = sensitive_terms(packed, found, support, share)
    kind = "array<struct<start: bigint, kind: int, end: bigint, class: string>>"
    if terms is None:
        joined = found.withColumn("added", F.expr(f"cast(array() as {kind})"))
    else:
        # texts without sensitive terms skip the join
        joined = found.join(term_spans(packed, terms).hint("shuffle_hash"), "text_hash", "left").withColumn("added", F.coalesce("added", F.expr(f"cast(array() as {kind})")))
    free = F.filter("added", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    base = F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"], F.lit(None).cast("string").alias("class")))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat(base, free)), lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["class"].alias("class")))
    named = F.transform("base", lambda b: F.struct(F.element_at(names, b["kind"] + 1).alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(PATTERNS)]
    return joined.select(*[F.col(own)[c].alias(c) for c in others], *counts, F.sha2(spans_text(named), 256).alias("base_sha256"), spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with protected entities as ``[kind]``, generalised terms as ``[class]``, removed ones left out. Of overlapping spans the first one's text goes, and what others have beyond it."""
    start = F.expr("struct(cast(0 as bigint) as at, cast(array() as array<struct<from: bigint, to: bigint, instead: string>>) as out)")
    instead = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", F.concat(F.lit("["), s["class"], F.lit("]"))).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    last = F.struct(F.lit("remove").alias("kind"), F.length(text).cast("long").alias("start"), F.length(text).cast("long").alias("end"), F.lit(None).cast("string").alias("class"))

    def step(acc: Column, s: Column) -> Column:
        part = F.struct(acc["at"].alias("from"), F.greatest(acc["at"], s["start"]).alias("to"), F.when(s["start"] < acc["at"], "").otherwise(instead(s)).alias("instead"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], part).alias("out"))

    parts = F.aggregate(F.array_append(spans, last), start, step)["out"]
    # a gap may be longer than a piece: it is taken in steps of one
    gap = lambda cut, p: F.array_join(F.transform(F.sequence(p["from"], F.greatest(p["from"], p["to"] - 1), F.lit(PIECE).cast("long")), lambda a: between(cut, a, F.least(p["to"] - a, F.lit(PIECE).cast("long")))), "")
    return let(pieces(text), lambda cut: F.array_join(F.transform(parts, lambda p: F.concat(gap(cut, p), p["instead"])), ""))
