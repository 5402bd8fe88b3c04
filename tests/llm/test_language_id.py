import random
import zlib

import numpy as np

from plumbline.llm.language_id import BiGru, Labeller, fitted, identify_languages, sampled, segments


def test_gradients_match_differences():
    net = BiGru.fresh(3, 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = np.random.default_rng(0).integers(97, 100, (5, 6)), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(x, y)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, losses = net.w[k][i], []
        for step in (1e-5, -1e-5):
            net.w[k][i] = kept + step
            losses.append(net.gradients(x, y)[0])
        net.w[k][i] = kept
        assert abs(g[i] - (losses[0] - losses[1]) / 2e-5) < 1e-6


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(2)
    pieces = {"xx": ["ka", "to", "mi"], "yy": ["sch", "ung", "ei"], "zz": ["ção", "que", "lh"]}
    rows = [(i, " ".join("".join(rng.choice(pieces[k]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), k) for i in range(300) for k in [rng.choice(list(pieces))]]
    edge = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !?", "yy"), (1003, "katomi kato", None), (None, "schung eischung", None), (1004, "x" * 100_000, "xx"), (1005, "katomi kato", "xx"), (1005, "katomi kato", "xx")]
    df = spark.createDataFrame([(*r, "s", 0.0) for r in rows + edge], "doc_id long, text string, lang string, source string, score double")
    got = identify_languages(df).collect()
    assert len(got) == len(rows) + len(edge)
    by = {r.doc_id: r for r in got}
    right = [by[i].lang_pred == k for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(right) > 0.95 * len(right) > 30
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[1003].lang_pred == "xx" and by[None].lang_pred == "yy" and 0 <= by[1004].score <= 1


def test_labels_agree_with_plain_loops():
    """Every position of every segment in plain loops over bytes; documents pool them."""
    net, kinds = BiGru.fresh(3, 5, seed=4), ["a", "b", "c"]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(word, d):
        h, out = np.zeros(5), {}
        for t in range(len(word)) if d == "f" else range(len(word) - 1, -1, -1):
            given, back = net.w[f"W{d}"][word[t]].astype(float), h @ net.w[f"U{d}"].astype(float)
            z, r = sig(given[:5] + back[:5]), sig(given[5:10] + back[5:10])
            h = (1 - z) * np.tanh(given[10:] + r * back[10:]) + z * h
            out[t] = h
        return out

    def plain(text):
        votes = []
        for word in [w[i : i + 32] for w in text.encode().lower().split() for i in range(0, len(w), 32)]:
            f, b = states(word, "f"), states(word, "b")
            logits = [f[t] @ net.w["Vf"] + b[t] @ net.w["Vb"] + net.w["c"] for t in range(len(word))]
            votes.append(np.mean([x - np.log(np.exp(x).sum()) for x in logits], axis=0))
        p = np.exp(2.0 * np.mean(votes, axis=0))
        return kinds[int(p.argmax())], p.max() / p.sum()

    texts = ["One two ÜBER", "x" * 70 + " yz", "a", "mixed 12 %% words\tand\nlines " * 20]
    names, scores = Labeller(kinds, net.w, 2.0).label(texts)
    for text, name, score in zip(texts, names, scores):
        want, p = plain(text)
        assert name == want and abs(score - p) < 1e-4


def test_samples_are_bounded_and_scores_tell_junk(spark):
    rng = random.Random(9)
    pieces = {"xx": ["ka", "to", "mi"], "yy": ["sch", "ung", "ei"]}
    say = lambda k, n: " ".join("".join(rng.choice(pieces[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(k, 30), k) for i in range(240) for k in [rng.choice("xy") * 2]]
    rows += [(7, "the same row " * 9, "xx")] * 60  # repeated rows count once
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sampled(df, max_docs=10, max_langs=1, doc_segments=5, max_segments=1000).collect()
    assert len({r.lang for r in got}) == 1 and len(got) == 10 and all(len(r.segments) <= 5 for r in got)
    # a language with more segments than its bound: every row keeps the same share at even steps, before anything is collected
    whole = {r.mark: r.segments for r in sampled(df, max_docs=10, max_langs=1, doc_segments=30, max_segments=1000).collect()}
    cut = {r.mark: r.segments for r in sampled(df, max_docs=10, max_langs=1, doc_segments=30, max_segments=60).collect()}
    assert set(cut) == set(whole) and 60 <= sum(map(len, cut.values())) <= 70
    share = 60 / sum(map(len, whole.values()))
    assert all(abs(len(cut[m]) - share * len(whole[m])) <= 1 and cut[m][0] == whole[m][0] for m in whole)
    junk = spark.createDataFrame([(1, "qwp zzx vvk wqq xzv " * 30, None), (2, say("xx", 40), None), (3, say("yy", 3), None)], "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in identify_languages(junk, fitted(df)).collect()}
    assert score[1] < min(score[2], score[3]) and min(score[2], score[3]) > 0.8


def test_no_labels_and_one_language(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "1", None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in identify_languages(df).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    one = spark.createDataFrame([(i, "abc", "xx") for i in range(9)] + [(9, "5", "xx")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in identify_languages(one).collect()} == {("xx", 1.0), ("und", 0.0)}
    assert identify_languages(one.limit(0)).count() == 0


def test_segments_cover_the_whole_text():
    text = "Ab " + "é" * 50 + "\tZ"
    assert b"".join(segments(text)) == text.encode().lower().replace(b" ", b"").replace(b"\t", b"")
    assert max(map(len, segments(text))) <= 32
