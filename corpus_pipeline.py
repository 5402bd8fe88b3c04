"""The corpus pipeline: five stages of a training-data clean-up, each over all that its predecessor kept.

Every stage is (spark, docs, sf_dir) -> DataFrame and returns the columns of ``documents``, but for the last, which returns
the packing. ``run`` writes each stage's result as a table and rereads it for the next.

Line dedup comes before the Jaccard join: it takes lines that copies share from all but one of them, so that near copies meet the join with fewer words in common
than their full texts have, and some no longer link. What they shared is gone from the corpus by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import drop, fresh, light_batches, written
from plumbline.llm.decontamination import decontaminate
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.language_id import UNKNOWN, identify_languages
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.packing import best_fit_pack
from plumbline.llm.queries import table, tokenizer_path

#: A language is rejected below this probability of its mean vote: no learned language stands out. With four languages chance is 0.25. Clean documents lie
#: well above, as do those in two languages; letters without any learned language come down to chance.
LEAST_SCORE = 0.3
#: Words that a Python worker remembers while it packs: fewer than the operator's own, as the executors are full from earlier stages.
WORD_MEMORY = 200_000
#: Tables that results of stages read. A result is written before the next stage begins; then its table is but a second copy of it.
LEFT: list[DataFrame] = []


def drop_left(docs: DataFrame) -> None:
    """Deletes the tables behind earlier stages' results of this session, unless ``docs`` still reads them (or holds cached tables, which do not tell)."""
    mine = [df for df in LEFT if df.sparkSession is docs.sparkSession]
    if not mine or "InMemoryRelation" in docs._jdf.queryExecution().optimizedPlan().toString():
        return
    read = docs.inputFiles()
    for df in mine:
        if not any(f"/{df.written_to.rsplit('/', 1)[-1]}/" in file for file in read):
            drop(df)
            LEFT.remove(df)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter or without a likely language go."""
    # other columns travel in one, so that none is taken for a result
    others = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    own = fresh("_own", docs.columns)
    found = identify_languages(docs.select("doc_id", "text", "lang", F.struct(*others).alias(own)) if others else docs)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    kept = kept.select(*[F.col(own)[c].alias(c) if c in others else F.col(c) for c in docs.columns])
    with light_batches(spark, rows=1000):  # whole rows pass the workers: less memory of theirs and of the executors
        kept = written(kept, "known-language")
    LEFT.append(kept)
    return kept


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat; n_chars follows the text."""
    drop_left(docs)
    own = fresh("_own", docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = line_dedup(docs.select("doc_id", "text", F.struct(*others).alias(own)) if others else docs.select("doc_id", "text"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select(*[n_chars if c == "n_chars" else F.col(own)[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id, those without an id last; texts without a word are no copies.

    Rows are told apart by id and text: different texts under one id, or without one, are documents of their own.
    """
    own = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    row, copies = fresh("_row", docs.columns), fresh("_copies", docs.columns)
    rows = docs.select(own.alias("doc_id"), "text")
    groups = jaccard_components(rows).groupBy("doc_id", "n_shingles", "component_id").agg(F.count("*").alias("rows")).withColumnRenamed("doc_id", "row")
    ids = docs.select(own.alias("row"), "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "n_shingles", "rows")
    stay = groups.join(ids.hint("shuffle_hash"), "row").groupBy("component_id").agg(F.min(rank).alias("r"))
    # copies of one row: with words one of them stays
    stay = written(stay.select(F.col("r.row").alias(row), ((F.col("r.n_shingles") > 0) & (F.col("r.rows") > 1)).alias(copies)), "stay")
    kept = docs.withColumn(row, own).join(stay.hint("shuffle_hash"), row)
    if stay.where(copies).isEmpty():
        return kept.select(*docs.columns)
    whole = F.struct(*docs.columns)  # of rows that differ elsewhere the first as JSON: a map has no order of its own
    first = kept.where(copies).groupBy(row).agg(F.min_by(whole, F.to_json(whole)).alias("r"))
    return kept.where(~F.col(copies)).select(*docs.columns).unionByName(first.select("r.*"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of all kept documents into token sequences."""
    return best_fit_pack(docs, tokenizer_path(), word_memory=WORD_MEMORY)


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed),
]

#: The first stage is a trained network and the last a tokenizer: no SQL expresses the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        drop_left(docs)
        if hasattr(before, "written_to"):
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
