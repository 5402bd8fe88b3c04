import random

from pyspark.sql import functions as F

from plumbline.llm.minhash import BINS, bin_minima, densified, fingerprint_pairs, likeness, packed, shingle_hashes


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_pairs_against_plain_rules(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gämma", "d", "epsilon\U0001f600"]) + str(rng.randrange(300)) for _ in range(n))
    rows = [(i * 7 - 50, say(rng.choice([0, 1, 3, 5, 40, 200, 900]))) for i in range(120)]
    rows += [(5000, rows[3][1]), (5001, rows[3][1]), (6000, None), (6001, ""), (6002, "  \n"), (None, "no id here at all")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bins string")
    got = {r.doc_id: r for r in fingerprint_pairs(df).withColumn("print", packed(F.col("bins"))).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    errors = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r.text, r.edited) == (t, edited), i
        errors += [abs(r.near_edited - jaccard(t, edited)), abs(r.near_next - jaccard(t, after))]
    assert sum(errors) / len(errors) < 0.02 and max(errors) < 0.2
    assert got[5000].print == got[5001].print != got[order[0][0]].print and len(got[5000].print) == 2 * BINS
    assert got[6000].print == got[6001].print == got[6002].print and got[6000].print[0] == "-"


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    (r,) = fingerprint_pairs(one).collect()
    assert r.edited == "a b c d e f a b" and r.near_next == 1.0
    assert fingerprint_pairs(one.limit(0)).count() == 0


def test_bins_keep_the_least_hash_and_borrow_alike(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a b c d e f g h i j k",)], "text string")
    h = shingle_hashes(F.col("text"))
    for r in df.select(h.alias("h"), bin_minima(h).alias("m"), densified(bin_minima(h)).alias("d")).collect():
        bins = {}
        for x in r.h:
            b = (x >> 56) + 128
            bins[b] = min(x, bins.get(b, x))
        assert len(r.m) == len(r.d) == BINS and all(r.m[b] == x and r.d[b] == x & 255 for b, x in bins.items())
        assert len(set(r.d)) > 60  # borrowed bits are hashed anew


def test_likeness_corrects_for_chance(spark):
    row = spark.range(1).select(*[F.array(*[F.lit((i * k) % 251) for i in range(BINS)]).alias(n) for n, k in (("a", 1), ("b", 7))], F.lit(None).cast("array<int>").alias("n"))
    r = row.select(*[likeness(F.col(x), F.col(y)).alias(x + y) for x, y in ("aa", "ab", "an", "nn")]).first()
    assert r.aa == 1.0 and 0 <= r.ab < 0.02 and r.an == 0.0 and r.nn == 1.0
