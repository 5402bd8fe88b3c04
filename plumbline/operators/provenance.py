"""Provenance facts from metadata: markers, manifests, label maps, wording checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from ahocorasick import AHOCORASICK, Automaton
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.functions.tables import drop, written
from plumbline.params import FORBIDDEN_PHRASES, FORBIDDEN_WORDS, MANIFEST_SCHEMA


def first_marker(text: Column, markers: list[tuple[str, str]]) -> Column:
    """Label of the first marker, in list order, that the text holds in any case."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), label) for m, label in markers])


#: Markers that are looked for one after another, as an expression; more of them by an automaton.
ONE_BY_ONE = 16
#: Bytes of the markers of one automaton at most: a worker's trie takes up to about a hundred times as much.
TRIE_BYTES = 2 << 20


def automaton(markers: list[str]) -> tuple[Automaton, int]:
    """The automaton of all markers, whose values are their least ranks, and the rank of the empty one (their number if there is none)."""
    found, ranks = Automaton(), {}
    for rank, m in enumerate(markers):
        ranks.setdefault(m, rank)
    empty = ranks.pop("", len(markers))
    for m, rank in ranks.items():
        found.add_word(m, rank)
    found.make_automaton()
    return found, empty


def first_rank(text: str, machine: Automaton, empty: int) -> int:
    """The least rank of a marker in the text, ``empty`` if there is no lesser one."""
    least = empty
    if machine.kind == AHOCORASICK:
        for _, rank in machine.iter(text):
            if rank < least:
                least = rank
                if not rank:
                    break
    return least


def scan_markers(texts: DataFrame, rows: list[Row]) -> DataFrame:
    """``texts`` with _rank and label of the first of ``rows`` that _low holds, where no marker is known yet."""
    shared = texts.sparkSession.sparkContext.broadcast(([r["marker"] for r in rows], [r["label"] for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markers, labels = shared.value
        machine, empty = automaton(markers)
        for batch in batches:
            low, known, label = (batch.column(c) for c in ("_low", "_known", "label"))
            ranks = [None if k or t is None else first_rank(t, machine, empty) for t, k in zip(low.to_pylist(), known.to_pylist(), strict=True)]
            hits = [r is not None and r < len(markers) for r in ranks]
            told = {"_known": pa.array([k or h for k, h in zip(known.to_pylist(), hits, strict=True)], pa.bool_()), "label": pa.array([labels[r] if h else x for r, h, x in zip(ranks, hits, label.to_pylist(), strict=True)], pa.string())}
            yield pa.RecordBatch.from_arrays([told.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return texts.mapInArrow(scan, texts.schema)


def marker_join(texts: DataFrame, markers: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``texts`` with ``label``: the first marker by ``pos`` of a user's marker table (pos, marker, label) that ``text`` holds in any case; null for none.

    Few markers are an expression on the text's own row. More of them are an Aho-Corasick automaton, broadcast, that reads each text once, however many markers there
    are, in Arrow batches; no text is shuffled. A table of more than ``trie_bytes`` is scanned by one automaton after another, in the order of its markers: each writes what it
    found before the next begins, so that a worker holds one of them, whatever their number. Null markers and texts match nothing; a marker is found as it is written, in the
    lower-cased text.
    """
    parts: list[list[Row]] = [[]]
    size = 0
    # of equal markers only the first is ever told
    firsts = markers.where(F.col("marker").isNotNull()).groupBy("marker").agg(F.min(F.struct("pos", "label")).alias("first"))
    for r in firsts.select("first.pos", "marker", "first.label").orderBy("pos", "marker", "label").toLocalIterator():
        size += len(r["marker"].encode()) + len((r["label"] or "").encode())
        if size > trie_bytes and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(r)
    if len(parts) == 1 and len(parts[0]) <= ONE_BY_ONE:
        label = first_marker(F.col("text"), [(r["marker"], r["label"]) for r in parts[0]]) if parts[0] else F.lit(None).cast("string")
        return texts.withColumn("label", label)
    found, last = texts.withColumns({"label": F.lit(None).cast("string"), "_known": F.lit(False)}), None
    for k, rows in enumerate(parts):
        found = scan_markers(found.withColumn("_low", F.lower("text")), rows).drop("_low")
        if k < len(parts) - 1:
            found = written(found, "marked")
            if last is not None:
                drop(last)
            last = found
    return found.drop("_known")


def manifest(json: Column) -> Column:
    """Struct (present, valid, signer, trusted_signer) of a manifest store; broken JSON is present and invalid, none is absent and unknown."""
    read = F.from_json(json, MANIFEST_SCHEMA)
    absent = json.isNull() | (json == "")
    broken = F.try_parse_json(json).isNull()
    entry = F.try_element_at(read["manifests"], read["active_manifest"])["signature_info"]
    blank = lambda c: F.when(c != "", c)
    return F.struct(
        (~absent).alias("present"),
        F.when(absent, F.lit(None).cast("boolean")).when(broken, False).otherwise(F.coalesce(F.size(read["validation_status"]) <= 0, F.lit(True))).alias("valid"),
        F.when(~absent & ~broken, F.coalesce(blank(entry["issuer"]), blank(entry["common_name"]))).alias("signer"),
        F.lit(None).cast("boolean").alias("trusted_signer"),
    )


def positive_index(labels: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """(model, index, problem) from ``labels(model, index, label)``: the one index that only positive hints match, or the other of two where one is negative.

    Anything else is a problem with a null index: no index is guessed.
    """
    low = F.lower("label")
    has = lambda hints: F.coalesce(*[F.when(F.contains(low, F.lit(h)), True) for h in hints], F.lit(False))
    sums = labels.groupBy("model").agg(
        F.collect_list(F.when(has(positive), F.col("index"))).alias("pos"), F.collect_list(F.when(has(negative), F.col("index"))).alias("neg"), F.collect_list("index").alias("all")
    )
    only = F.array_except("pos", "neg")
    rest = F.array_except("all", "neg")
    index = F.when(F.size(only) == 1, F.get(only, F.lit(0))).when((F.size("all") == 2) & (F.size("neg") == 1) & (F.size(only) == 0), F.get(rest, F.lit(0)))
    return sums.select("model", index.alias("index"), F.when(index.isNull(), "ambiguous labels").alias("problem"))


def forbidden_terms(text: Column) -> Column:
    """Banned words and phrases that a text holds."""
    low = F.lower(text)
    words = F.array_intersect(F.split(F.regexp_replace(low, "-", " "), " +"), F.array(*[F.lit(w) for w in FORBIDDEN_WORDS]))
    phrases = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), p) for p in FORBIDDEN_PHRASES]))
    return F.array_union(words, phrases)


def schema_diff(one: DataFrame, other: DataFrame) -> DataFrame:
    """(side, field) of the fields (field) that only one side has."""
    return one.select("field").exceptAll(other.select("field")).select(F.lit("left").alias("side"), "field").unionByName(other.select("field").exceptAll(one.select("field")).select(F.lit("right").alias("side"), "field"))
