"""Hot groups, large grids, many markers and crowded scores: results as from plain rules, and no task that gets all rows."""

import random

import numpy as np
import pytest
from plumbline.functions.numbering import numbered
from plumbline.functions.tables import written
from plumbline.operators import grids, jobs, metrics, provenance, sampling
from pyspark.sql import functions as F


def test_numbers_in_one_hot_group(spark):
    rows = [("hot", i * 7919 % 30011) for i in range(30011)] + [(None, i) for i in range(50)] + [(f"g{i}", i) for i in range(200)]
    df = written(spark.createDataFrame(rows, "g string, k long").repartition(5), "hot")
    found = numbered(df, ["g"], ["k"])
    got = {(r.g, r.k): (r._n, r._all) for r in found.collect()}
    assert got == {**{("hot", k): (k, 30011) for k in range(30011)}, **{(None, k): (k, 50) for k in range(50)}, **{(f"g{k}", k): (0, 1) for k in range(200)}}
    # no window over the rows: only range sizes were summed, and no range holds the group
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    share = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert share < 0.5 * len(rows)


def test_systematic_cap_and_balanced_sample_of_a_hot_group(spark):
    df = written(spark.range(20_000).select(F.lit("a").alias("g"), F.col("id").alias("k"), F.lit(1).alias("label")), "cap")
    assert sorted(r.k for r in sampling.systematic_cap(df, "g", "k", 100).collect()) == list(range(0, 20_000, 200))
    chosen = sampling.balanced_sample(df, 40, 7, key="k")
    order = [r.k for r in df.orderBy(F.md5(F.concat(F.lit("7|"), F.col("k").cast("string")))).limit(20).collect()]
    assert sorted(r.k for r in chosen.collect()) == sorted(order) and chosen.columns == df.columns


def plain_grid(v):
    """All statistics of a whole grid."""
    h, w = v.shape
    p = np.pad(v, 1, mode="reflect") if min(h, w) > 1 else np.pad(v, 1, mode="edge")
    blur = np.var(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * v)
    e = np.pad(v, 1, mode="edge")
    residue = v - np.median(np.stack([e[a : a + h, b : b + w] for a in range(3) for b in range(3)]), axis=0)
    th, tw = h // 4, w // 4
    energy = [residue[a * th : (a + 1) * th, b * tw : (b + 1) * tw].var() for a in range(4) for b in range(4)]
    steps = []
    for u in (v, v.T):
        d = np.abs(np.diff(u, axis=0)).mean(1)
        on = np.arange(len(d)) % 8 == 7
        steps.append(d[on].mean() / d[~on].mean() - 1)
    return blur, np.std(energy) / np.mean(energy), max(steps)


@pytest.fixture(scope="module")
def large(spark):
    rng = np.random.default_rng(3)
    grids_ = {k: rng.normal(size=shape).cumsum(0) for k, shape in (("large", (150, 90)), ("small", (40, 33)))}
    rows = [(k, y, x, float(v[y, x])) for k, v in grids_.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return grids_, written(spark.createDataFrame(rows, "grid_id string, y int, x int, v double").repartition(8), "grid")


def test_grids_by_tiles_agree_with_whole_grids(spark, large):
    grids_, cells = large
    blur, noise, steps = ({r[0]: r[1] for r in f(cells, side=16).collect()} for f in (grids.laplacian_variance, grids.tile_noise_cv, grids.grid_step_contrast))
    for k, v in grids_.items():
        assert (blur[k], noise[k], steps[k]) == pytest.approx(plain_grid(v), rel=1e-9)
    for f in (grids.block_dct_stats, grids.radial_profile):
        one, many = (sorted(map(tuple, f(cells, side=side).collect())) for side in (256, 16))
        assert [x[0] for x in one] == [x[0] for x in many] and np.allclose([x[1:] for x in one], [x[1:] for x in many], rtol=1e-9)
    capped = {r.grid_id: r.kurtosis for r in grids.block_dct_stats(cells, cap=7, side=16).collect()}
    for k, v in grids_.items():
        blocks = [v[a * 8 : a * 8 + 8, b * 8 : b * 8 + 8] - 128 for a in range(v.shape[0] // 8) for b in range(v.shape[1] // 8)]
        ac = np.concatenate([(grids.WAVES @ b @ grids.WAVES.T)[1:, 1:].ravel() for b in blocks[:: max(1, len(blocks) // 7)][:7]])
        assert capped[k] == pytest.approx(((ac - ac.mean()) ** 4).mean() / ac.var() ** 2, rel=1e-6)


def test_a_tile_is_all_that_a_task_gets_of_a_grid(spark, large):
    _, cells = large
    kernel = lambda t: {"n": [t.own.size], "filled": [int((~np.isnan(t.v)).sum())]}
    got = grids.by_tile(cells, kernel, "n long, filled long", side=16).where("grid_id = 'large'").collect()
    assert len(got) == 10 * 6 and sum(r.n for r in got) == 150 * 90 and max(r.filled for r in got) == 18 * 18


def test_tiny_grids(spark):
    rows = [("one", 0, 0, 3.0), *[("column", y, 0, float(y * y)) for y in range(5)]]
    cells = written(spark.createDataFrame(rows, "grid_id string, y int, x int, v double"), "tiny")
    blur = {r.grid_id: r.blur for r in grids.laplacian_variance(cells).collect()}
    assert blur["one"] == 0 and blur["column"] == pytest.approx(np.var([2, 2, 2, 2, -14]))
    for f, c in ((grids.tile_noise_cv, "noise_cv"), (grids.grid_step_contrast, "grid_strength")):
        assert {r[c] for r in f(cells).collect()} == {0.0}
    assert {r.v for r in grids.radial_profile(cells, 4).collect()} == {0.0}


def test_markers_by_automaton_agree_with_plain_search(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abÄ ") for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, "")]
    markers = [(rng.randint(0, 50), "".join(rng.choice("abä ") for _ in range(rng.randint(2, 6))), rng.choice(["x", "y", "z", None])) for _ in range(60)] + [(3, "AB", "upper"), (4, None, "none")]
    for extra, size in (([], 1 << 20), ([], 40), ([(25, "", "empty")], 60)):
        table = sorted(((p, m, x) for p, m, x in markers + extra if m is not None), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
        found = provenance.marker_join(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(markers + extra, "pos int, marker string, label string"), trie_bytes=size)
        assert found.columns == ["id", "text", "label"]
        got = {r.id: r.label for r in found.collect()}
        for i, text in texts:
            assert got[i] == next((x for _, m, x in table if text is not None and m in text.lower()), None), text


def test_crowded_scores_are_dealt_evenly(spark):
    rng = np.random.default_rng(8)
    crowded = np.unique(np.round(0.5 + rng.normal(size=60_000) * 1e-3, 8))
    rows = [("d", "x", int(i % 3 == 0), float(s)) for i, s in enumerate(crowded)] + [("d", "few", i % 2, i / 10) for i in range(10)]
    cells = metrics.score_cells(spark.createDataFrame(rows, "dataset string, detector string, label int, score double"))
    sizes = {(r.detector, r.range): (r["count"], r.low, r.high) for r in cells.groupBy("detector", "range").agg(F.count("*").alias("count"), F.min("score").alias("low"), F.max("score").alias("high")).collect()}
    own = [v for k, v in sorted(sizes.items()) if k[0] == "x"]
    assert len(own) == -(-len(crowded) // metrics.RANGE_CELLS) and max(n for n, _, _ in own) < 1.5 * metrics.RANGE_CELLS
    assert all(a[2] < b[1] for a, b in zip(own, own[1:])) and ("few", 0) in sizes


def test_bootstrap_on_cells_is_that_on_rows(spark):
    rng = np.random.default_rng(9)
    label = rng.integers(0, 2, 900)
    score = np.round(np.clip(rng.normal(0.45 + 0.1 * label, 0.15), 0.01, 0.99), 2)
    df = spark.createDataFrame([("d", "x", int(y), float(s)) for y, s in zip(label, score)], "dataset string, detector string, label int, score double")
    got = metrics.bootstrap_auc(df, resamples=400).first()

    def plain():
        w = rng.poisson(1, len(score))
        order = np.argsort(score, kind="stable")
        s, y, w = score[order], label[order], w[order]
        p, n = (np.bincount(np.unique(s, return_inverse=True)[1], w * (y == k)) for k in (1, 0))
        return (p * (np.cumsum(n) - n / 2)).sum() / (p.sum() * n.sum())

    low, high = np.percentile([plain() for _ in range(400)], [2.5, 97.5])
    assert got.replicates == 400 and abs(got.low - low) < 0.012 and abs(got.high - high) < 0.012


def test_rules_counted_and_enforced(spark):
    df = spark.createDataFrame([(1, 0.5, 3), (2, 1.5, 0), (3, None, 4), (4, 0.1, 0)], "id long, score double, w int")
    checks = {"score": F.col("score") <= 1, "width": F.col("w") > 0, "id": F.col("id") > 0}
    assert {r.rule: r.broken for r in jobs.violation_counts(df, checks).collect()} == {"score": 1, "width": 2, "id": 0}
    assert jobs.strict(df.where("id % 2 = 1"), checks).count() == 2
    with pytest.raises(Exception, match="rule broken: width"):
        jobs.strict(df.where("id = 4"), checks).collect()


def test_poisson_tables():
    for k in (1, 7, 300, 5_000_000):
        low, cumulative = metrics.poisson_table(k)
        p = np.diff(cumulative, prepend=0)
        n = low + np.arange(len(p))
        mean = (p * n).sum()
        assert mean == pytest.approx(k, rel=1e-7) and (p * (n - mean) ** 2).sum() == pytest.approx(k, rel=1e-4)
