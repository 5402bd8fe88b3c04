"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontamination import contaminated
from plumbline.llm.hidden_markov import hmm_scores
from plumbline.llm.html_text import html_extract
from plumbline.llm.language_id import identify_languages
from plumbline.llm.licenses import license_scan
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.merkle import FAN, FIELDS, manifest, verified
from plumbline.llm.minhash import fingerprint_pairs, packed
from plumbline.llm.packing import best_fit_pack
from plumbline.llm.sanitisation import sanitisation, spans_text
from plumbline.llm.secrets import secret_scan
from plumbline.llm.spelling import spelling_variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint_pairs(table(spark, sf_dir, "documents"))
    digest = F.sha2("edited", 256).alias("edited_sha256")
    prints = packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint")
    return pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), digest, *prints, "near_edited", "near_next")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "hits", "agreed", "compared")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return labelled.select("doc_id", "held_out", "lang_pred", "score")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = verified(manifest(table(spark, sf_dir, "documents")))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitisation(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("spans", spans_text(F.col("spans"))).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
  from lines),
frequent as (
  select line_key, max(doc_id) as last_doc from keyed where length(line_key) >= 20
  group by line_key having count(distinct doc_id) >= 3),
marked as (
  select k.doc_id, k.line, k.pos, f.last_doc is not null and k.doc_id <> f.last_doc as dropped
  from keyed k left join frequent f using (line_key))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count_if(dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""


OP9_SQL = r"""
with recursive cut as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select doc_id, unnest(list_distinct(case
    when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s
  from cut),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
both_ways as (select x, y from links union all select y, x from links),
reached as (
  select doc_id, doc_id as c from documents
  union
  select b.y, r.c from reached r join both_ways b on b.x = r.doc_id)
select d.doc_id, coalesce(max(z.n), 0) as n_shingles, min(r.c) as component_id
from documents d join reached r on r.doc_id = d.doc_id left join sizes z on z.doc_id = d.doc_id group by d.doc_id
"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes: half a byte at a time, by the table of the reflected polynomial."""
    table_ = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table_.append(k)
    digits = f"hex(encode({text}))"
    halves = f"list_transform(range(1, length({digits}) + 1), lambda i: instr('0123456789ABCDEF', {digits}[(i + 1 - 2 * ((i + 1) % 2))::int]) - 1)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {halves}), lambda c, b: xor(c >> 4, {table_}[(xor(c, b) & 15) + 1]::bigint)), 4294967295)"


#: Levels of the trees in SQL: enough for 8 ** OP11_LEVELS rows of one language.
OP11_LEVELS = 8


def op11_sql() -> str:
    field = lambda c, x: f"case when {c} is null then '-' else strlen({x}::varchar) || ':' || ({x}::varchar) end"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digest = lambda changed: "sha256(" + " || ".join(field(c, changed.get(c, c)) for c in FIELDS) + ")"
    steps = [
        f"""rows_ as (select doc_id, lang, {digest({})} as leaf, case when {crc32_sql("doc_id::varchar")} % 3 = 0 then {digest({"text": lowered})} end as tampered from documents),
  a0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as n, leaf as digest from rows_)"""
    ]

    def levels(tag: str, key: str) -> None:
        for k in range(OP11_LEVELS):
            steps.append(f"""{tag}s{k} as (select {key}, n // {FAN} as m, list(digest order by n) as kids, count(*) over (partition by {key}) as runs from {tag}{k} group by {key}, m)""")
            steps.append(f"""{tag}{k + 1} as (select {key}, m as n, case when runs = 1 and len(kids) = 1 then kids[1] else sha256(array_to_string(kids, '')) end as digest from {tag}s{k})""")

    levels("a", "lang")
    steps.append(f"b0 as (select 0 as one, lang, digest, row_number() over (order by lang nulls first) - 1 as n from a{OP11_LEVELS})")
    levels("b", "one")

    def proof(tag: str, key: str, source: str, name: str) -> None:
        """Siblings before and behind the selected child at each level."""
        joins, left, right, up = [], [], [], []
        for k in range(OP11_LEVELS):
            joins.append(f"join {tag}s{k} on {tag}s{k}.{key} is not distinct from r.{key} and {tag}s{k}.m = r.n // {FAN ** (k + 1)}")
            at = f"(r.n // {FAN**k} % {FAN})::int"
            left.append(f"array_to_string({tag}s{k}.kids[:{at}], '')")
            right.append(f"array_to_string({tag}s{k}.kids[{at} + 2:], '')")
            up.append(f"not ({tag}s{k}.runs = 1 and len({tag}s{k}.kids) = 1)")
        columns = [f"{x} as {name}{c}{k}" for k in range(OP11_LEVELS) for c, x in (("l", left[k]), ("r", right[k]), ("u", up[k]))]
        steps.append(f"{name} as (select r.*, {', '.join(columns)} from {source} r {' '.join(joins)})")

    proof("b", "one", "b0", "p")
    proof("a", "lang", "a0", "q")
    sides = [(n, k) for n in ("q", "p") for k in range(OP11_LEVELS)]
    steps.append(f"j as (select q.*, p.digest as subroot, b{OP11_LEVELS}.digest as root, {', '.join(f'p.p{c}{k}' for c in 'lru' for k in range(OP11_LEVELS))} from q join p on q.lang is not distinct from p.lang cross join b{OP11_LEVELS})")
    steps.append("f0 as (select *, coalesce(tampered, leaf) as f from j)")
    for i, (n, k) in enumerate(sides):
        steps.append(f"f{i + 1} as (select * replace (case when {n}u{k} then sha256({n}l{k} || f || {n}r{k}) else f end as f) from f{i})")
    siblings = " || ".join(f"{n}l{k} || {n}r{k}" for n, k in sides)
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, root, sha256({siblings}) as proof_sha256, f as folded_root, f = root as verified from f{len(sides)}"


OP13_SQL = rf"""
with recursive runs as (
  select doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+'),
                                       lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as run
  from documents),
counted as (select doc_id, run, count(*) as k from runs where length(run) >= 6 group by 1, 2),
hashed as (select *, {crc32_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from counted),
cut as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed),
words as (select word, cast(sum(k) as bigint) as n from cut where length(word) >= 6 group by 1 having sum(k) >= 5),
gaps as (select word, n, i, left(word, i::int - 1) || substr(word, i::int + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select g.word, w.word, w.n from gaps g join words w on g.rest = w.word
  union select w.word, g.word, g.n from gaps g join words w on g.rest = w.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by 1),
formed as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 5 * w.n then b.near end as form, case when b.near_n >= 5 * w.n then b.near_n end as form_n
  from words w left join best b on b.word = w.word),
way as (
  select word, word as at, form as ahead from formed
  union all select y.word, y.ahead, f.form from way y join formed f on f.word = y.ahead)
select f.word, f.form, y.at as root, f.n, f.n_near, f.form_n from formed f join way y on y.word = f.word and y.ahead is null
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_secret_scan": op2_secret_scan,
        "op3_decontamination": op3_decontamination,
        "op4_best_fit_pack": op4_best_fit_pack,
        "op5_language_id": op5_language_id,
        "op6_html_extract": op6_html_extract,
        "op7_hidden_markov": op7_hidden_markov,
        "op8_license_scan": op8_license_scan,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_line_dedup": op10_line_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_sanitisation": op12_sanitisation,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_jaccard_join": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_merkle_manifest": op11_sql(), "op13_spelling_variants": OP13_SQL}
