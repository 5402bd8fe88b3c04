import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from plumbline.llm.merkle import manifest, verified
from plumbline.llm.queries import op11_merkle_manifest, oracle_sql

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def proofs_of(leaves):
    """(top, siblings of each leaf from below) of a tree, straight from the rule."""
    paths = [[] for _ in leaves]
    nodes = [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 8):
            run = nodes[k : k + 8]
            for j, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((h(*[d for d, _ in run]), [i for _, own in run for i in own]))
        nodes = above
    return nodes[0][0], paths


def plain(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    trees = {}
    for lang, own in by_lang.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = own, *proofs_of([leaf_of(r) for r in own])
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    root, ways = proofs_of([trees[x][1] for x in langs])
    out = []
    for lang, way in zip(langs, ways, strict=True):
        own, subroot, paths = trees[lang]
        for row, path in zip(own, paths, strict=True):
            path = path + way
            at = leaf_of(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                at = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in path:
                at = h(left, at, right)
            out.append((row[0], leaf_of(row), subroot, root, h(*[x for s in path for x in s]), at, at == root))
    return Counter(out)


def corpus(n, langs, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([None, 5, 70]), rng.choice(["Über\nall", "plain", "", None, "X" * 3000, f"Text {i}"])) for i in range(n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (9, ["en"]), (70, ["en", "de", None]), (600, ["en"]), (1200, ["en", "en", "en", "é", "z", None, *map(str, range(20))])])
def test_proofs_agree_with_the_plain_rule(spark, tmp_path, n, langs):
    rows = corpus(n, langs, n)
    rng = random.Random(1)
    rows += [rng.choice(rows) for _ in range(n // 10)] + [(None, "s", rng.choice(langs), 1, f"No {i % 3}") for i in range(n // 20)] + [(rows[0][0], "other", rows[0][2], 2, "Same id")] * (n > 1)
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in op11_merkle_manifest(spark, str(tmp_path)).collect()) == plain(rows)


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = op11_merkle_manifest(spark, sf)
    found = con.sql(oracle_sql()["op11_merkle_manifest"])
    at = [found.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_some_requests_and_other_columns(spark):
    rows = corpus(300, ["en", "de", None], 4) + [(None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], COLUMNS + ", n long, leaf string, tree string")
    asked = spark.createDataFrame([(3,), (3,), (250,), (None,), (9999,)], "doc_id long")
    got = verified(manifest(docs, asked)).drop("path", "tampered").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r) for r in got.collect()) == Counter({k: v for k, v in plain(rows).items() if k[0] in (3, 250, None)})


def test_empty_table(spark):
    assert verified(manifest(spark.createDataFrame([], COLUMNS))).count() == 0
