"""The pipeline against a plain version of its stages, on tables small enough for pairs."""

import random

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from plumbline.llm.decontamination import LEAST, WINDOW
from plumbline.llm.queries import tokenizer_path
from tests.llm.test_decontamination import plain as leaks
from tests.llm.test_jaccard_join import plain_components
from tests.llm.test_line_dedup import plain as plain_lines


def corpus(seed=6):
    rng = random.Random(seed)
    pieces = {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ei", "ver"]}
    say = lambda k, n: " ".join("".join(rng.choice(pieces[k]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    benchmark = [(i, say("xx", 20)) for i in range(3)]
    shared = [say("xx", 12) for _ in range(3)]
    rows = []
    for i in range(120):
        k = rng.choice("xy") * 2
        lines = [say(k, rng.randint(3, 30)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.append(rng.choice(shared))
        if i % 17 == 0:
            lines.append(say("xx", 3) + " " + rng.choice(benchmark)[1])
        if i % 7 == 0 and rows:
            lines = rows[-1][1].split("\n")
        rows.append((i, "\n".join(lines), k))
    rows += [(500, None, "xx"), (501, "12 ? !!", "yy"), (502, "", "xx")]
    return rows, benchmark


def test_stages_against_plain_versions(spark, tmp_path):
    rows, benchmark = corpus()
    df = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = [(i, t) for i, t, _ in rows if i < 500]  # texts without a letter go
    now = [(int(i), kept) for i, _, _, kept in plain_lines(now)]
    groups = {i: c for i, _, c in plain_components(now)}
    now = [(i, t) for i, t in now if groups[i] == i]
    now = [(i, t) for i, t in now if not any(leaks(t, b) for _, b in benchmark)]
    assert 20 < len(now) < 110 and LEAST < WINDOW

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(now)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in now}
    assert {r.doc_id: r.length for r in packed} == sizes
    filled = np.bincount([r.sequence_id for r in packed], weights=[r.length for r in packed])
    assert filled.max() <= 4096 and (filled > 0).sum() <= -(-sum(sizes.values()) // 4096) + 1


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    twice = [(1, "kato mire katomi", "xx", "s", 16)] * 2 + [(2, "schung verei", "yy", "s", 12), (None, "mito kare", "xx", "s", 9)]
    docs = spark.createDataFrame(twice, schema)
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_rows_with_a_map(spark):
    rows = [(1, "kato mire katomi", {"a": 2}), (1, "kato mire katomi", {"a": 1}), (2, "schung verei", None), (2, "schung verei", None)]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>"), "")
    assert sorted((r.doc_id, r.m) for r in kept.collect()) == [(1, {"a": 1}), (2, None)]


def test_unrelated_texts_under_one_id_stay(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, say(k)) for k in range(6)] + [(7, say(k)) for k in range(6, 12)] + [(20 + k, say(k)) for k in (0, 3, 8)]
    rows += [(None, say(1)), (7, say(9)), (40, say(50)), (41, say(50)), (None, ""), (None, ""), (42, None)]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(None, say(k)) for k in (1, 2, 4, 5)] + [(20, say(0)), (23, say(3))] + [(7, say(k)) for k in range(6, 12)]
    want += [(40, say(50)), (None, ""), (None, ""), (42, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    names = ["score", "lang_pred", "held_out", "_row", "_copies", "_own", "_doc", "n_lines", "rows", "component_id"]
    text = ["ka to mi re ka to mi " * 4 + f"number {i}\nline of its own {i} and more words" for i in range(12)]
    rows = [(i, t, "xx" if i % 2 else "yy", "s", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(text)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, "nothing of this is held by any")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    got = docs.collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_letters_of_no_language_go(spark):
    rows, _ = corpus()
    docs = [(i, t, k, "s", len(t or "")) for i, t, k in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, df, "").collect()}
    assert {i for i, t, _ in rows if i < 500} <= kept and not kept & {500, 501, 502}


def test_a_passage_of_many_items_in_a_long_text(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    long_text = " ".join(f"w{i % 977}" for i in range(40_000))
    spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(1000)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"{long_text} {passage} end"), (2, long_text)], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in corpus_pipeline.without_benchmarks(spark, docs, str(tmp_path)).collect()] == [2]
