import random

import numpy as np
import pyarrow as pa

from plumbline.llm import jaccard_join
from plumbline.llm.jaccard_join import bands, differing, jaccard_components, set_signatures
from plumbline.llm.shingles import shingle_sets, word_hashes


def plain_set(text):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("é", "x", "yz", "Q")]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 8, 9, 12, 14, 30, 60, 200, 500]))]
            if kind > 0.85:
                words += passage
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(words)))
    return rows


def test_components_against_brute_force(spark, monkeypatch):
    rows = near_copies(1)
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    want = plain_components(rows)
    assert sorted(map(tuple, jaccard_components(df).collect())) == want
    monkeypatch.setattr(jaccard_join, "HOT", 2)  # nearly every signature counts as hot
    assert sorted(map(tuple, jaccard_components(df).collect())) == want
    for name, value in (("SAMPLED", 1), ("CROWD", 3), ("SALTS", 3)):  # and those of three sets as crowded
        monkeypatch.setattr(jaccard_join, name, value)
    assert sorted(map(tuple, jaccard_components(df).collect())) == want


def test_all_texts_of_an_id_are_tied(spark):
    texts = {1: "a b c d e f g", 2: "h i j k l m n", 3: "o p q r s t u", 4: "v w x y z", 9: "other words of no copy"}
    rows = [*texts.items(), (5, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[3]), (6, texts[4])]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (9, 9)}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  two"), (6, "one two three"), (None, "one two"), (7, "a b c d e f g"), (7, "x y z"), (8, "x y z"), (9, "a b c d e f g"), (9, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(df).collect())
    want = [("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "None"), ("5", 1, "None"), ("6", 1, "6"), ("None", 1, "None"), ("7", 3, "7"), ("7", 1, "7"), ("8", 1, "7"), ("9", 3, "7"), ("9", 3, "7")]
    assert got == sorted(want)
    assert jaccard_components(df.limit(0)).count() == 0


def test_signatures_of_linked_sets_meet():
    rng, share = np.random.default_rng(2), (4, 5)
    for n in [*range(1, 80), 120, 200, 333, 700, 1500]:
        for _ in range(6):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            most = n * 5 // 4
            b_size = int(rng.integers(max(1, -(-n * 4 // 5)), most + 1))
            d = differing(n, b_size, share)
            d -= (d + n + b_size) % 2
            common = (n + b_size - d) // 2
            if d < 0 or common > min(n, b_size) or 5 * common < 4 * (n + b_size - common):
                continue
            b = np.concatenate((a[:common], rng.integers(0, 2**63, b_size - common).astype(np.uint64)))
            if set(a) == set(b):
                continue
            keys = [{int(k) for ks, _, _ in set_signatures(np.sort(x), share) for k in ks} for x in (a, b)]
            assert keys[0] & keys[1], (n, b_size, d)


def test_bands_hold_every_partner():
    tops, _ = bands(5000, (4, 5))
    for low, high in zip(tops, tops[1:]):
        assert high >= low * 5 // 4 and high > low


def test_shingles_of_bytes():
    texts = ["The a\tb c  D e", "", "x", "é Ü É \x1c y z", "the A b C d E"]
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts))]
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts] and sets[0] == sets[4]
    value, bounds = word_hashes(pa.array(["p q", None, "q p"]).fill_null("").slice(1))
    assert bounds.tolist() == [0, 0, 2] and len(value) == 2
