import random

from plumbline.llm.decontamination import LEAST, MASKS, WINDOW, contaminated, decontaminate, picked


def plain(text, item):
    """Whether any aligned window agrees in enough tokens, by trying all."""
    t, b = (text or "").lower().split(), (item or "").lower().split()
    if not b:
        return False
    size = min(WINDOW, len(b))
    for i in range(len(b) - size + 1):
        for j in range(-size + 1, len(t)):
            agreed = sum(0 <= j + k < len(t) and t[j + k] == b[i + k] for k in range(size))
            if agreed * WINDOW >= size * LEAST:
                return True
    return False


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, tokens string, seed int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_masks_find_any_two_substitutions():
    import itertools

    for gone in itertools.combinations(range(WINDOW), 2):
        assert any(all(a + i not in gone for i in picked(m)) for m in MASKS for a in range(WINDOW - len(m) + 1)), gone


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([3, 8, 12, 13, 20, 40])))) for i in range(12)] + [(50, None), (51, "")]
    texts = []
    for i in range(150):
        words = say(rng.randint(0, 60))
        if i % 3:
            passage = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "other"
            words[rng.randint(0, len(words)) :] = passage + say(5)
        texts.append((i, " ".join(words)))
    texts += [(900, None), (901, ""), (902, "\t \n"), (None, items[5][1]), (3, texts[3][1])]
    docs, bench = frames(spark, texts, items)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    want = {(i, k) for i, t in texts for k, b in items if plain(t, b)}
    assert got <= want
    assert len(got) >= 0.97 * len(want)  # three substitutions in a window may escape the masks
    split = {(r.doc_id, r.item_id) for r in contaminated(docs, bench, max_seeds=100).collect()}
    assert split == got
    left = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert left == {i for i, _ in texts} - {i for i, _ in got}


def test_two_substitutions_anywhere_in_a_long_item(spark):
    import itertools

    item = [f"b{i}" for i in range(40)]
    texts = []
    for start in (0, 14, 27):  # the head, the middle and the tail of the item
        for gone in itertools.combinations(range(WINDOW), 2):
            passage = ["other" if i in gone else w for i, w in enumerate(item[start : start + WINDOW])]
            before, after = (["x"] * k for k in (len(texts) % 3, len(texts) % 5))
            texts.append((len(texts), " ".join(before + passage + after)))
        for gone in itertools.combinations(range(WINDOW), 4):
            texts.append((len(texts), " ".join("other" if i in gone else w for i, w in enumerate(item[start : start + WINDOW]))))
    docs, bench = frames(spark, texts, [(1, " ".join(item))])
    found = contaminated(docs, bench).collect()
    want = {i for i, t in texts if plain(t, " ".join(item))}
    assert len(want) == 3 * 78 and {r.doc_id for r in found} == want
    assert all((r.agreed, r.compared) == (WINDOW - 2, WINDOW) for r in found)


def test_empty_tables(spark):
    docs, bench = frames(spark, [], [(1, "a b c d e f g h i j k l m n")])
    assert contaminated(docs, bench).count() == 0
    docs, bench = frames(spark, [(1, "a b")], [])
    assert contaminated(docs, bench).count() == 0 and decontaminate(docs, bench).count() == 1


def test_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, item, "a", "b"), (2, "clean text of no item at all", "c", "d")], "doc_id long, text string, _doc string, _TEXT_HASH string")
    kept = decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "clean text of no item at all", "c", "d")]


def test_passage_of_many_items_in_a_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    long_text = " ".join([f"w{i % 977}" for i in range(40_000)] + [passage] + [f"v{i % 977}" for i in range(20)])
    docs, bench = frames(spark, [(1, long_text)], [(i, f"own{i} {passage} end{i}") for i in range(1000)])
    found = contaminated(docs.coalesce(1), bench).collect()
    assert sorted(r.item_id for r in found) == list(range(1000))
    assert all((r.agreed, r.compared) == (WINDOW, WINDOW) for r in found)


def test_blocks_of_a_large_benchmark_are_joined_one_at_a_time(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(20)]
    docs, bench = frames(spark, [(i, f"a {t} b") for i, t in items], items)
    found = contaminated(docs, bench, max_seeds=200)
    assert found._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") <= 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i, _ in items}


def test_stretches_and_equal_items(spark, monkeypatch):
    say = lambda k, n: " ".join(f"{k}{i % 31}" for i in range(n))
    items = [(1, say("a", 50)), (2, say("A", 50)), (2, say("b", 14)), (3, say("c", 9)), (None, say("b", 14)), (4, "x y"), (5, "X  Y"), (1, say("a", 50))]
    texts = [(1, say("q", 30) + " " + say("a", 40)), (2, say("b", 90)), (3, "z " + say("c", 9)), (4, "x y x y"), (5, say("a", 33) + " " + say("b", 20)), (6, "x")]
    docs, bench = frames(spark, texts, items)
    rows = lambda **options: sorted(map(str, contaminated(docs, bench, **options).collect()))
    whole = rows()
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(i, k) for i, t in texts for k, b in items if plain(t, b)}
    monkeypatch.setattr("plumbline.llm.decontamination.STRETCH", 7)
    assert rows() == rows(max_seeds=60) == whole
