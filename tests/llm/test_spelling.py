import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from plumbline.llm.queries import op13_spelling_variants, oracle_sql
from plumbline.llm.spelling import near_rows, spelling_variants


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b))) if len(a) < len(b) else sum(x != y for x, y in zip(a, b, strict=True)) == 1


def plain(rows, min_chars, min_count, every, ratio):
    n = Counter()
    for doc, text in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    parts = ["an", "ba", "É", "na", "ñ", "B", "a", "÷", "ý"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([3, 10, 60])]) + rng.choice(["", ",", "Ā", "9", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, "banana BANANA banana"), (n, None), (n + 1, ""), (n + 2, "a" * 3000 + " " + "a" * 2999 + "b"), (n + 2, "a" * 3000)]


def test_agrees_with_the_plain_rule(spark):
    for seed, kind in ((1, (3, 2, 7, 2)), (2, (4, 1, 5, 3)), (3, (1, 1, 2, 1.5))):
        rows = corpus(seed, 40)
        docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(4)
        min_chars, min_count, every, ratio = kind
        got = tuples(spelling_variants(docs, min_chars, min_count, every, ratio, block=5))
        expected = plain(rows, *kind)
        assert got == expected and sum(r[1] is not None for r in got) > 3


def test_long_ways_to_the_root(spark):
    text = " ".join(w for k, w in enumerate(["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]) for _ in range(2**k))
    got = {r.word: r.root for r in spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), min_count=1, ratio=2, every=10**9).collect()}
    assert set(got.values()) == {"aabbbb"} and len(got) == 5


def test_near_rows_of_random_words():
    rng = np.random.default_rng(5)
    for la, lb in ((6, 6), (6, 7)):
        a, b = (np.unique(rng.integers(97, 99, (40, n)).astype(np.uint8), axis=0) for n in (la, lb))
        got = set(zip(*near_rows(a, b, False, step=7), strict=True))
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if one_edit(bytes(a[i]).decode(), bytes(b[j]).decode())}


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = op13_spelling_variants(spark, sf)
    found = con.sql(oracle_sql()["op13_spelling_variants"])
    at = [found.columns.index(c) for c in got.columns]
    assert tuples(got) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
