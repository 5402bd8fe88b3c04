"""Secret scan with linking of multipart credentials.

One pass over each text finds spans. *Strong* kinds are reported wherever they are: ``assign`` (a secret's name, a sign and a
value), ``access`` (an access identifier), ``hex`` (a long run of hex digits), ``pem`` (a private key's block) and ``jwt`` (a signed token). *Weak* kinds would be noise alone:
``ident`` (an account, client or user name given by a sign), ``mail`` (an address, user@host), ``opaque`` (a long mixed token), ``endpoint`` (the address of a
service) and ``host`` (a numeric address, with or without a port). A weak span is reported only if a complementary part lies in its scope: an interval join on (text, cell of
``scope`` code points) links identifiers, secrets and endpoints that start at most ``scope`` code points apart.

The parts of a credential: identifiers (access, ident, mail), secrets (assign, hex, pem, jwt, opaque), endpoints (endpoint, host). A part complements
those of the other two sorts; an endpoint and an identifier without a secret are no credential, so endpoints and weak identifiers ask for
a secret, and weak secrets for an identifier or an endpoint. Weak identifiers and secrets that overlap a strong span are part of it.

A cell holds at most as many spans as characters fit into it, so that no document, however long, makes a large group.
Null texts are empty. Rows that repeat a doc_id are scanned each on its own. Extra columns pass through, but for those that
have the name of a result (in any case), which the result replaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import fresh, written

#: The base patterns; the least length of the named part.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
STRONG = (("assign", 6), ("access", 20), ("hex", 24))
#: Patterns of our own.
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
IDENT = re.compile(r"""\b(?:user(?:name|_?id)?|login|account|client_?id|access_?id|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})""", re.I | re.A)
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}", re.A)
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.A)
HOST = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![\w.]*[0-9])", re.A)
KINDS = ("assign", "access", "hex", "pem", "jwt", "ident", "mail", "opaque", "endpoint", "host")
#: Kinds below this number are strong; those below 3 are the base kinds.
WEAK = 5
IDENTIFIERS, ENDPOINTS = (1, 5, 6), (8, 9)
SCOPE = 400
FOUND = "row_sha256 string, n_assign long, n_access long, n_hex long, base_sha256 string, strong array<struct<kind:int,start:int,end:int>>, weak array<struct<kind:int,start:int,end:int>>"
FOUND_NAMES = ["row_sha256", "n_assign", "n_access", "n_hex", "base_sha256", "strong", "weak"]
DIGITS = re.compile(r"[0-9a-f]{24}")
DIGIT = re.compile(r"[0-9]")


def has_sign(text: str) -> bool:
    """Whether a named value can be in the text at all; most prose needs no closer look."""
    return "=" in text or ":" in text


def hex_spans(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least 24 hex digits: each run is one leftmost match of HEX, found by any 24 of its digits."""
    spans, at = [], 0
    while m := DIGITS.search(text, at):
        at = HEX.match(text, m.end())
        at = at.end() if at else m.end()
        spans.append((m.start(), at))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong kinds by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if has_sign(text) else []
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(a, 2, b) for a, b in hex_spans(text)]
    return sorted(spans)


def more_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong kinds beside the base ones."""
    spans = [(m.start(), 3, m.end()) for m in PEM.finditer(text)] if "PRIVATE KEY-----" in text else []
    spans += [(m.start(), 4, m.end()) for m in JWT.finditer(text)] if "eyJ" in text else []
    return spans


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    spans = [(m.start(), 5, m.end()) for m in IDENT.finditer(text)] if has_sign(text) else []
    spans += [(m.start(), 6, m.end()) for m in MAIL.finditer(text)] if "@" in text else []
    if DIGIT.search(text):
        spans += [(m.start(), 7, m.end()) for m in OPAQUE.finditer(text)]
        spans += [(m.start(), 9, m.end()) for m in HOST.finditer(text)]
    spans += [(m.start(), 8, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    spans.sort()
    out, k = [], 0
    ends = sorted((a, b) for a, _, b in strong)
    for a, kind, b in spans:
        while k < len(ends) and ends[k][1] <= a:
            k += 1
        if kind in ENDPOINTS or k == len(ends) or ends[k][0] >= b:  # the first strong span that ends behind the weak one's start tells whether any overlaps
            out.append((a, kind, b))
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanner(column: str):
    """The spans of each text of ``column`` beside the batch's other columns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        structs = lambda all_: pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in all_], kind)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            base = [base_spans(t) for t in texts]
            strong = [s + more_spans(t) for t, s in zip(texts, base, strict=True)]
            weak = [weak_spans(t, s) for t, s in zip(texts, strong, strict=True)]
            count = lambda k: pa.array([sum(x[1] == k for x in s) for s in base], pa.int64())  # noqa: B023, E731
            added = [pa.array([hashlib.sha256(t.encode()).hexdigest() if w else None for t, w in zip(texts, weak, strict=True)], pa.string()), count(0), count(1), count(2)]
            added += [pa.array([hashlib.sha256(spans_text(s).encode()).hexdigest() for s in base], pa.string()), structs(strong), structs(weak)]
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, kept + FOUND_NAMES)

    return scan


def linked_weak(found: DataFrame, scope: int) -> DataFrame:
    """(row_sha256, linked): the weak spans of each text that have a complementary part in their scope."""
    has = found.where(F.size("weak") > 0).dropDuplicates(["row_sha256"])
    parts = has.select("row_sha256", F.explode(F.concat("strong", "weak")).alias("p")).select("row_sha256", "p.*")
    sort = F.when(F.col("kind").isin(*IDENTIFIERS), "identifier").when(F.col("kind").isin(*ENDPOINTS), "endpoint").otherwise("secret")
    parts = parts.withColumn("sort", sort).withColumn("cell", F.floor(F.col("start") / scope))
    ask = parts.where(F.col("kind") >= WEAK).alias("a")
    give = parts.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).alias("g")
    fits = F.when(F.col("a.sort") == "secret", F.col("g.sort") != "secret").otherwise(F.col("g.sort") == "secret")
    near = F.abs(F.col("a.start") - F.col("g.start")) <= scope
    links = ask.join(give.hint("shuffle_hash"), (F.col("a.row_sha256") == F.col("g.row_sha256")) & (F.col("a.cell") == F.col("g.cell")) & near & fits, "left_semi")
    return links.groupBy("row_sha256").agg(F.collect_set(F.struct("kind", "start", "end")).alias("linked"))


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs(doc_id, text, ...)`` without the text, with n_assign, n_access, n_hex, base_sha256 and ``secrets``: structs of kind, start, end by start, then kind."""
    others = [c for c in docs.columns if c.lower() not in {"text", "n_assign", "n_access", "n_hex", "base_sha256", "secrets"}]
    # other columns travel in one, so that none is taken for a column of ours
    own, rest = fresh("_text", docs.columns), fresh("_rest", docs.columns)
    source = docs.select((F.struct(*others) if others else F.lit(None).cast("int")).alias(rest), F.coalesce("text", F.lit("")).alias(own))
    schema = T.StructType([f for f in source.schema if f.name != own] + T._parse_datatype_string(FOUND).fields)
    found = written(source.mapInArrow(scanner(own), schema), "secrets")
    # texts without weak spans need no join; the table of the others is written, so that many copies of one text are split
    linked = written(linked_weak(found, scope), "linked")
    none = F.expr("cast(null as array<struct<kind:int,start:int,end:int>>)").alias("linked")
    asked = found.where("row_sha256 is not null").join(linked.hint("shuffle_hash"), "row_sha256", "left")
    joined = asked.unionByName(found.where("row_sha256 is null").select("*", none))
    spans = F.concat("strong", F.coalesce("linked", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    named = F.transform(ordered, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(*[F.col(rest)[c].alias(c) for c in others], "n_assign", "n_access", "n_hex", "base_sha256", named.alias("secrets"))
