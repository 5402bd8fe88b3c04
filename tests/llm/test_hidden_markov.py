import math
import random
import zlib

import numpy as np
import pyarrow as pa

from plumbline.llm import hidden_markov as hm


def slow_forward(model, classes):
    a = model.start * model.of_class[classes[0]]
    log = math.log(a.sum())
    a = a / a.sum()
    for c in classes[1:]:
        a = (a @ model.move) * model.of_class[c]
        log += math.log(a.sum())
        a = a / a.sum()
    return log


def slow_expected(model, classes):
    """Plain forward-backward of one short sequence."""
    k, n = len(model.start), len(classes)
    b = model.of_class[classes]
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    alpha[0] = model.start * b[0]
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] @ model.move) * b[t]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (b[t + 1] * beta[t + 1])
    p = alpha[-1].sum()
    gamma = alpha * beta / p
    move, emit = np.zeros((k, k)), np.zeros((k, model.emit.shape[1]))
    for t in range(1, n):
        move += np.outer(alpha[t - 1], b[t] * beta[t]) * model.move / p
    for t in range(n):
        emit[:, classes[t]] += gamma[t]
    return np.concatenate((gamma[0], move.ravel(), emit.ravel())), math.log(p)


def example(seed=0):
    rng = np.random.default_rng(seed)
    model = hm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3))
    sizes = [1, 2, 63, 64, 65, 128, 129, 200, 5]
    return model, rng.integers(0, 7, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))


def test_forward_is_exact():
    model, classes, bounds = example()
    got = model.forward(hm.Blocks(classes, bounds))[0]
    want = [slow_forward(model, classes[a:b]) for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(got, want, rtol=1e-12)


def test_expected_counts_are_exact_and_training_helps():
    model, classes, bounds = example(1)
    got, log = model.expected(hm.Blocks(classes, bounds))
    parts = [slow_expected(model, classes[a:b]) for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(got, sum(x for x, _ in parts)) and math.isclose(log, sum(x for _, x in parts))
    logs = []
    for _ in range(6):
        counts, log = model.expected(hm.Blocks(classes, bounds))
        logs.append(log)
        model = hm.Model.from_counts(counts, 3, 7)
    assert all(b > a - 0.5 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0]


def test_scores_against_plain_counts(spark):
    rng = random.Random(1)
    words = {"x": [f"{a}ing" for a in "abcdefgh"], "y": [f"{a}eux" for a in "klmnopqr"]}
    rows = [(i, " ".join(rng.choice(words[rng.choice("xy") if i % 5 == 0 else "xy"[i % 2]]) for _ in range(rng.randint(1, 150)))) for i in range(240)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "NEVER seen\x1cbefore Aing"), (None, "aing"), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, c int")
    got = {}
    for r in hm.hmm_scores(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    split = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     "))).split(" ") if w] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = {}
    for i, t in rows:
        if not held(i):
            for w in split(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    better = 0
    for i, t in rows:
        r, tokens = got[i][0], split(t)
        assert len(got[i]) == sum(x == i for x, _ in rows)
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held(i), len(tokens), n, sum(w in count for w in tokens))
        assert math.isclose(r.base_score, sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        better += r.score > r.base_score
    assert better > 0.75 * len(rows)  # a fifth of the texts mix both kinds of words


def test_empty_tables(spark):
    assert hm.hmm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = hm.hmm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_states_are_fitted_to_distinct_texts_of_bounded_length(spark, monkeypatch):
    texts = ["aing bing aing", "keux leux keux", "cing ding " * 50, "aing bing aing"]
    df = spark.createDataFrame([(1, t) for t in texts * 3] + [(2, texts[1])], "doc_id long, text string")
    seen = []

    class Watched(hm.Blocks):
        def __init__(self, classes, bounds):
            seen.append(len(bounds) - 1)
            super().__init__(classes, bounds)

    shares = np.full(hm.CLASSES, 1 / hm.CLASSES)
    monkeypatch.setattr(hm, "Blocks", Watched)
    monkeypatch.setattr(hm, "INIT_BYTES", 100)
    hm.trained(df, shares, 2, rounds=0)
    assert seen == [3]  # (1, aing), (1, keux), (2, keux); repeated rows count once and the long text is left to the rounds over all
    monkeypatch.setattr(hm, "INIT_BYTES", 3)
    monkeypatch.setattr(hm, "Blocks", Watched.__bases__[0])
    fresh, model = hm.Model.fresh(shares, 2), hm.trained(df, shares, 2, rounds=1)
    assert any(not np.allclose(a, b) for a, b in zip(vars(fresh).values(), vars(model).values()) if isinstance(a, np.ndarray) and a.shape == b.shape)


def test_classes():
    keys, classes, bounds = hm.word_classes(pa.array(["running xning", "", "RUNNING"]))
    assert bounds.tolist() == [0, 3, 4, 6] and classes[0] == classes[1] == classes[4]
    assert keys[0] == keys[4] != keys[1] and (keys[[2, 3, 5]] == hm.END_KEY).all()
