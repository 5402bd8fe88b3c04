import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as sc
from plumbline.functions.tables import small
from plumbline.operators import calibrate, fingerprint, fusion, metrics, provenance, rollup
from plumbline.params import BANDS, FORBIDDEN_WORDS, NEXT_STEPS
from plumbline.plans.conclusion import conclusion
from plumbline.plans.protocol import cross_dataset


def rolled(spark, scores, spreads=None):
    spreads = spreads or [0.0] * len(scores)
    rows = [(1, i + 1, 10, s, d) for i, (s, d) in enumerate(zip(scores, spreads))]
    return rollup.rollup_parts(spark.createDataFrame(rows, "item_id long, part_index int, h int, score double, spread double")).first()


def test_rollup_patterns_and_factors(spark):
    r = rolled(spark, [0.05, 0.08, 0.10, 0.12, 0.95])
    assert (r.score, r.pattern, r.rollup_penalties[0].factor) == (0.95, "single_outlier", 0.735)
    assert rolled(spark, [0.1] * 40 + [0.9]).rollup_penalties[0].factor == 0.55
    r = rolled(spark, [0.9, 0.88])
    assert r.pattern == "several_elevated" and not r.rollup_penalties
    r = rolled(spark, [0.8, 0.82, 0.79, 0.85])
    assert r.pattern == "all_elevated" and r.rollup_penalties[0].factor == 0.85
    assert rolled(spark, [0.3]).pattern == "single_part" and rolled(spark, [0.1, 0.2]).pattern == "none_elevated"
    assert rolled(spark, [0.45, 0.1]).n_elevated == 1
    assert rolled(spark, [0.7, 0.7, 0.1], [0.02, 0.9, 0.5]).spread == 0.02  # the first of equal parts


def fused(spark, rows, weights):
    scores = spark.createDataFrame([(1, *r) for r in rows], "item_id long, detector string, score double")
    return fusion.fuse(fusion.weight_join(scores, spark.createDataFrame(weights, "detector string, weight double"))).first()


def test_fusion_rules(spark):
    w = [("spatial", 0.7), ("frequency", 0.3)]
    assert fused(spark, [("spatial", 1.0), ("frequency", 0.0)], w).score == pytest.approx(0.7)
    r = fused(spark, [("spatial", 0.4), ("other", 0.9), ("frequency", None)], w)
    assert r.score == pytest.approx(0.4) and r.disagreement == 0 and r.weights_used == {"spatial": 1.0}
    r = fused(spark, [("b", 0.6), ("a", 0.6), ("c", 0.1)], [])
    assert r.score == 0.6 and r.weights_used == {"a": 1.0} and r.disagreement == 0
    r = fused(spark, [("a", None)], w)
    assert r.score == 0.5 and r.weights_used == {}
    assert fused(spark, [("spatial", 1.0), ("frequency", 0.0)], w).disagreement == 0.5


def test_fusion_notes(spark):
    w = [("spatial", 0.7), ("frequency", 0.3)]
    assert fused(spark, [("spatial", 1.0), ("frequency", 0.0)], w).notes == ["weighted by validation AUC; the detectors lie 0.500 apart"]
    assert fused(spark, [("spatial", 1.0), ("frequency", None)], w).notes == []
    assert fused(spark, [("b", 0.6), ("a", 0.6)], []).notes == ["no weights are known for these detectors: the score is that of a"]
    assert fused(spark, [("a", None)], w).notes == ["no detector gave a score"]


def test_override_precedence(spark):
    rows = [(1, 0.1, "FLUX", None), (2, 0.95, "FLUX", True), (3, 0.9, None, True), (4, 0.2, None, True), (5, 0.9, None, False), (6, 0.9, None, None), (7, 0.5, "FLUX", True)]
    frame = spark.createDataFrame(rows, "id int, score double, marker string, manifest_valid boolean")
    out = {r.id: (r.score, r.override) for r in fusion.override(frame).collect()}
    assert out == {1: (0.88, "generator_metadata"), 2: (0.95, None), 3: (0.35, "c2pa_valid"), 4: (0.2, None), 5: (0.9, None), 6: (0.9, None), 7: (0.88, "generator_metadata")}
    noted = {r.id: r.notes for r in fusion.override(frame.withColumn("notes", F.array(F.lit("before")))).collect()}
    assert noted[2] == ["before"] and "FLUX" in noted[1][1] and "unnamed signer" in noted[3][1]


def test_conclusions_never_say_what_is_banned(spark):
    kinds = [("single_part", 1, 0), ("single_part", 1, 1), ("none_elevated", 4, 0), ("single_outlier", 5, 1), ("all_elevated", 3, 3), ("several_elevated", 2, 2), ("none_elevated", 0, 0)]
    df = spark.createDataFrame(kinds, "pattern string, n int, k int").select("*", conclusion(F.col("pattern"), F.col("n"), F.col("k"), F.lit("Mixed signals")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got[0].headline == "Mixed signals, from one part" and got[3].headline == "1 of 5 parts is elevated" and got[5].headline == "2 of 2 parts are elevated"
    assert "no part was found" in got[6].headline and got[6].next_steps == NEXT_STEPS["no_part"]
    assert got[2].next_steps == NEXT_STEPS["quiet"] and got[3].next_steps == NEXT_STEPS["raised_one"] and "(2)" in got[5].next_steps
    text = spark.createDataFrame([(t,) for c in got for t in c], "t string")
    assert text.where(F.size(provenance.forbidden_terms(F.col("t"))) > 0).count() == 0 and text.where(F.col("t").contains("{")).count() == 0


def test_small_tables_are_checked(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        small(spark.range(5), 3)
    assert small(spark.range(3), 3).count() == 3


def plain_roc(rows, drop):
    rows = sorted(rows, key=lambda r: -r[1])
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    points, tp, fp = [], 0, 0
    for i, (y, s) in enumerate(rows):
        tp, fp = tp + y, fp + 1 - y
        if i + 1 == len(rows) or rows[i + 1][1] != s:
            points.append((fp, tp, s))
    if drop and len(points) > 2:
        steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip([(0, 0, None), *points], points)]
        points = [x for i, x in enumerate(points) if i in (0, len(points) - 1) or steps[i] != steps[i + 1]]
    return [(0, 0.0, 0.0, None)] + [(i + 1, f / n, t / p, s) for i, (f, t, s) in enumerate(points)]


def test_curves_over_ranges_agree_with_plain_loops(spark):
    import random

    rng = random.Random(8)
    for spread in (0.001, 1.0, "edges", "tied"):
        make = {"edges": lambda: rng.choice([1 - 1e-9 * rng.random(), 1e-9 * rng.random(), 0.0, 1.0]), "tied": lambda: rng.randint(0, 4) / 4}.get(spread, lambda: 0.5 + spread * (rng.random() - 0.5))
        rows = [(rng.randint(0, 1), make()) for _ in range(400)]
        df = scores_frame(spark, [s for y, s in rows if y], [s for y, s in rows if not y])
        for drop in (True, False):
            got = sorted((r.idx, r.fpr, r.tpr, r.threshold) for r in metrics.roc_curve(df, drop_intermediate=drop).collect())
            assert got == plain_roc(rows, drop)
        wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
        pairs = sum(y for y, _ in rows) * sum(1 - y for y, _ in rows)
        assert metrics.auc(df).first().auc == pytest.approx(wins / pairs, abs=1e-12)


def test_one_hot_label_gives_no_rates(spark):
    df = scores_frame(spark, [0.2, 0.9], [])
    assert metrics.auc(df).first().auc is None
    assert [r.fpr for r in metrics.roc_curve(df).orderBy("idx").collect()] == [0.0, None, None]
    assert metrics.auc(df.limit(0)).count() == 0 and metrics.roc_curve(df.limit(0)).count() == 0 and metrics.evaluate(df.limit(0)).count() == 0


def test_fingerprint_links_are_whole(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)] + [base[0]] * 30
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(prints)], "id long, h long")
    rep = {}
    for i, h in enumerate(prints):
        rep.setdefault(h, i)
    for d in (1, 2, 3):
        want = {(min(a, b), max(a, b), (g ^ h).bit_count()) for g, a in rep.items() for h, b in rep.items() if a < b and (g ^ h).bit_count() <= d}
        assert {tuple(r) for r in fingerprint.near_duplicates(df, d).collect()} == want
    assert {tuple(r) for r in fingerprint.members(df).collect()} == {(i, rep[h]) for i, h in enumerate(prints)}


def test_bands_cover_the_unit_interval(spark):
    assert [b[1] for b in BANDS] == [0.0, *[b[2] for b in BANDS[:-1]]] and BANDS[-1][2] == 1.0
    edges = [0, 0.1, 0.2, 0.3, 0.45, 0.5, 0.7, 0.8, 0.88, 0.95, 1.0]
    df = spark.createDataFrame([(x * 1.0,) for x in edges], "score double")
    want = ["low", "low", "weak", "weak", "mixed", "mixed", "strong", "strong", "very_strong", "very_strong", "very_strong"]
    assert [r.b for r in df.select(sc.band(F.col("score")).alias("b")).collect()] == want
    assert sorted(r.band for r in sc.band_join(df, sc.band_table(spark)).collect()) == sorted(want)
    for bad in (-0.01, 1.01, math.nan):
        one = spark.createDataFrame([(bad,)], "score double")
        with pytest.raises(Exception, match="within 0 and 1"):
            one.select(sc.band(F.col("score"))).collect()
        assert sc.band_join(one, sc.band_table(spark)).count() == 0
    assert not any(set(label.lower().split()) & set(FORBIDDEN_WORDS) for *_, label in BANDS)


def test_intervals_and_confidence(spark):
    r = spark.range(1).select(
        sc.round4(sc.shrink_to_half(F.lit(0.712), F.lit(0.85))).alias("a"), sc.interval(F.lit(0.5), F.lit(0.0), F.lit(0.425)).alias("i"), sc.confidence(F.expr("cast(array() as array<struct<reason:string,factor:double>>)")).alias("c")
    ).first()
    assert r.a == 0.6802 and (r.i.lo, r.i.hi) == (0.2125, 0.7875) and r.c == 1.0


def test_temperature_and_hex(spark):
    r = spark.range(1).select(sc.apply_temperature(F.lit(0.9), F.lit(1.0)).alias("one"), sc.apply_temperature(F.lit(0.9), F.lit(0.0)).alias("zero"), sc.hex64(F.lit(-1).cast("long")).alias("h"), sc.from_hex64(F.lit("ffffffffffffffff")).alias("l")).first()
    assert r.one == pytest.approx(0.9) and r.zero == 0.9 and r.h == "f" * 16 and r.l == -1
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(sc.apply_temperature(F.lit(0.9), F.lit(-1.0), strict=True)).collect()
    with pytest.raises(Exception, match="16 hex"):
        spark.range(1).select(sc.from_hex64(F.lit("abc"))).collect()


def beta(seed, n, a, b):
    import random

    rng = random.Random(seed)
    return [rng.betavariate(a, b) for _ in range(n)]


def scores_frame(spark, positive, negative):
    rows = [(i, "d", "x", y, s) for i, (y, s) in enumerate([(1, s) for s in positive] + [(0, s) for s in negative])]
    return spark.createDataFrame(rows, "key long, dataset string, detector string, label int, score double")


def test_metrics_on_separable_and_calibrated_scores(spark):
    df = scores_frame(spark, [0.8, 0.9, 0.95] * 10, [0.1, 0.2, 0.3] * 10)
    r = metrics.evaluate(df).first()
    assert r.auc == 1.0 and r.eer == 0.0 and (r.n, r.n_positive, r.n_negative) == (60, 30, 30)
    assert metrics.calibration_bins(df).agg(F.sum("n")).first()[0] == 60
    few = metrics.tpr_at_fpr(df, metrics.roc_curve(df)).collect()
    assert {(x.target_fpr, x.measurable, x.tpr) for x in few} == {(0.01, False, None), (0.001, False, None)}
    wide = metrics.tpr_at_fpr(df, metrics.roc_curve(df), targets=(0.1,)).first()
    assert wide.measurable and wide.unstable and wide.tpr == 1.0


def test_auc_does_not_move_with_temperature_but_loss_falls(spark):
    positive, negative = beta(1, 120, 5, 2), beta(2, 120, 2, 5)
    sharp = lambda xs: [1 / (1 + math.exp(-4 * math.log(x / (1 - x)))) for x in xs]
    df = scores_frame(spark, sharp(positive), sharp(negative))
    t = calibrate.fit_temperature(df)
    moved = calibrate.calibrated(df, t)
    assert t.first().temperature > 1
    assert metrics.auc(moved).first().auc == pytest.approx(metrics.auc(df).first().auc)
    losses = {r.temperature: r.nll for r in calibrate.temperature_losses(df).collect()}
    assert min(losses.values()) < losses[1.0]
    ece = lambda f: metrics.calibration_error(metrics.calibration_bins(f)).first().ece
    assert ece(moved) < ece(df)


def test_bootstrap_brackets_and_narrows(spark):
    small = scores_frame(spark, beta(3, 30, 4, 2), beta(4, 30, 2, 4))
    large = scores_frame(spark, beta(3, 300, 4, 2), beta(4, 300, 2, 4))
    a, b = metrics.bootstrap_auc(small, resamples=60).first(), metrics.bootstrap_auc(large, resamples=60).first()
    assert a.low <= metrics.auc(small).first().auc <= a.high and a.high - a.low > b.high - b.low
    assert a.replicates == 60


def test_weights_from_auc(spark):
    def weights(rows):
        return {r.detector: r.weight for r in calibrate.derive_weights(spark.createDataFrame(rows, "detector string, auc double")).collect()}

    assert weights([("a", 0.9), ("b", 0.7)]) == {"a": 0.6667, "b": 0.3333}
    assert weights([("a", 0.8), ("b", 0.2)]) == {"a": 1.0, "b": 0.0}
    assert weights([("a", 0.5), ("b", 0.4)]) == {"a": 0.0, "b": 0.0}


def test_guards(spark):
    with pytest.raises(ValueError):
        cross_dataset(None, [], "a", "a")
    keys = spark.createDataFrame([(1,), (2,)], "key int")
    with pytest.raises(Exception, match="both splits"):
        calibrate.overlap_guard(keys, keys.limit(1)).collect()
    faces = spark.createDataFrame([(1, 1)], "item_id int, part_index int")
    with pytest.raises(Exception, match="differ"):
        rollup.align_parts(faces, spark.createDataFrame([(1, 2)], "item_id int, part_index int")).collect()


def test_label_hints_never_guess(spark):
    rows = [("m1", 0, "Realism"), ("m1", 1, "Deepfake"), ("m2", 0, "x"), ("m2", 1, "human"), ("m3", 0, "a"), ("m3", 1, "b"), ("m4", 0, "fake real"), ("m4", 1, "other"), ("m4", 2, "z")]
    found = provenance.positive_index(spark.createDataFrame(rows, "model string, index int, label string"), ["fake"], ["real", "human"])
    assert {r["model"]: r["index"] for r in found.collect()} == {"m1": 1, "m2": 0, "m3": None, "m4": None}
