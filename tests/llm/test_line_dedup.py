import random

import numpy as np

from plumbline.llm.line_dedup import line_dedup, perfect_seeds, slots
from pyspark.sql import functions as F


def plain(rows):
    """The rule by dictionaries: (doc_id, n_lines, n_dropped, kept) of each row."""
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: -(2**63) if i is None else i
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and order(i) != max(holders[key(x)]) for x in lines]
        out.append((str(i), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def test_against_plain_rule(spark):
    rng = random.Random(4)
    lines = [f"  Line number {i} that repeats É " for i in range(30)] + ["short", "", "\t", "x" * 19, "y" * 20, "Ünïcode línes are kept as they are", "ÜNÏCODE LÍNES ARE KEPT AS THEY ARE"]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), x.strip() + "\r"]) for x in rng.choices(lines, k=rng.randint(0, 12)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (7, rows[7][1]), (8, "a second text of document eight"), (None, rows[9][1]), (None, lines[0]), (600, "\n".join(["y" * 20] * 3000))]
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, hash string, n_lines int")
    for sizes in ({}, {"shard_keys": 3, "task_probes": 2}):
        got = line_dedup(df.drop("n_lines"), **sizes)
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == plain(rows)
        assert "hash" in got.columns


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "A line that is repeated often\nand one of its own", "a", "b", "c", 9) for i in range(4)], "doc_id long, text string, _doc string, _text_hash string, _DROPPED string, n_lines int")
    got = line_dedup(df).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r._doc, r._text_hash, r._DROPPED) for r in got] == [(2, 1, "a", "b", "c")] * 3 + [(2, 0, "a", "b", "c")]


def test_many_lines_in_one_document(spark):
    text = "\n".join(f"line number {i} of a very long document" for i in range(200_000))
    got = line_dedup(spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", (F.length("text") == len(text)).alias("whole")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 200_000, 200_000, False), (1, 200_000, 200_000, False), (2, 200_000, 0, True)]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 100, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (np.sort(slots(keys, perfect_seeds(keys), n)) == np.arange(n)).all()


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
