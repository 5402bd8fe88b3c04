"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one segment (a run without ASCII white space, A-Z lower-cased, cut every
``SEGMENT_BYTES`` bytes) in both directions and labels every position with log probabilities of the languages. A segment's vote is
the mean over its positions. A document's language is the one with the largest sum of votes; its score is that language's probability by the *mean* vote of a segment,
sharpened by a factor fitted to held-back training documents: so it tells how sure the network is of the text's segments, not how many there are.
State starts anew at each segment: a worker labels each distinct one once and reuses its vote, which is what lets it read whole texts, whatever
their length; context across segments is the price.

Trained in numpy on the driver by backpropagation through time with Adam, from a bounded sample: the ``max_langs`` most frequent languages, at most ``max_docs`` distinct rows of
each, those with the smallest hash of id and text, at most ``doc_segments`` segments of each row, spread over its whole text, and about ``max_segments`` of a language (the same share of
each row's, one at least), which are cut before they reach the driver. A quarter of the rows is held back from training for the factor.

Texts that are null or have no letter are ``und`` with score 0, as is everything where no labelled row exists. With one learned language all
other texts get it with score 1. Ties go to the first language by name. Rows that repeat an id are labelled each on its own; rows without an id are never held out. Extra columns pass
through, but for those named ``held_out``, ``lang_pred`` or ``score`` (in any case), which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from plumbline.llm.common import handing_back, least_hashes, written

SEGMENT_BYTES = 32
HIDDEN = 16
MAX_DOCS = 300
MAX_SEGMENTS = 12_000
MAX_LANGS = 200
DOC_SEGMENTS = 200
#: Factors on mean votes that are tried.
SHARPNESS = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
EPOCHS = 3
BATCH = 256
RATE = 0.01
#: Votes kept by a Python worker; beyond it, the memory starts anew.
VOTE_MEMORY = 300_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def segments(text: str) -> list[bytes]:
    """The byte segments of a whole text."""
    words = text.encode("utf-8", "replace").lower().split()
    if max(map(len, words), default=0) <= SEGMENT_BYTES:
        return words
    return [w[i : i + SEGMENT_BYTES] for w in words for i in range(0, len(w), SEGMENT_BYTES)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Weights by name: for each direction the input table W (256 x 3H, a byte's gate inputs), the recurrence U (H x 3H) and the output V (H x K); one bias c (K)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, kinds: int, hidden: int, seed: int = 1) -> BiGru:
        rng = np.random.default_rng(seed)
        w = {"c": np.zeros(kinds, np.float32)}
        for d in "fb":
            w[f"W{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            w[f"U{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            w[f"V{d}"] = rng.normal(0, hidden**-0.5, (hidden, kinds)).astype(np.float32)
        return cls(w)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps x batch x H) of one direction over bytes ``x`` (batch x steps), in the order of the steps."""
        W, U = self.w[f"W{d}"], self.w[f"U{d}"]
        hidden, steps = U.shape[0], x.shape[1]
        h = np.zeros((len(x), hidden), U.dtype)
        out = np.empty((steps, len(x), hidden), U.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            given, back = W[x[:, t]], h @ U
            gates = sigmoid(given[:, : 2 * hidden] + back[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            n = np.tanh(given[:, 2 * hidden :] + r * back[:, 2 * hidden :])
            if keep is not None:
                keep.append((t, h, z, r, n, back[:, 2 * hidden :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def log_probs(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log probabilities of every position (steps x batch x K)."""
        logits = f @ self.w["Vf"] + b @ self.w["Vb"] + self.w["c"]
        logits -= logits.max(-1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(-1, keepdims=True))

    def votes(self, x: np.ndarray) -> np.ndarray:
        return self.log_probs(self.states(x, "f"), self.states(x, "b")).mean(0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions and its gradients, backwards through time in both directions."""
        kept: dict[str, list] = {"f": [], "b": []}
        state = {d: self.states(x, d, kept[d]) for d in "fb"}
        logp = self.log_probs(state["f"], state["b"])
        steps, batch, _ = logp.shape
        loss = -float(logp[:, np.arange(batch), y].mean())
        dlogits = np.exp(logp)
        dlogits[:, np.arange(batch), y] -= 1
        dlogits /= steps * batch
        grads = {"c": dlogits.sum((0, 1))}
        for d in "fb":
            U, V = self.w[f"U{d}"], self.w[f"V{d}"]
            hidden = U.shape[0]
            grads[f"V{d}"] = np.einsum("tbh,tbk->hk", state[d], dlogits, optimize=True)
            dW, dU = np.zeros_like(self.w[f"W{d}"]), np.zeros_like(U)
            dh = np.zeros((batch, hidden), U.dtype)
            for t, h, z, r, n, back in reversed(kept[d]):
                dh = dh + dlogits[t] @ V.T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * back * r * (1 - r)
                dgiven = np.concatenate((dz, dr, dn), 1)
                dback = np.concatenate((dz, dr, dn * r), 1)
                np.add.at(dW, x[:, t], dgiven)
                dU += h.T @ dback
                dh = dh * z + dback @ U.T
            grads[f"W{d}"], grads[f"U{d}"] = dW, dU
        return loss, grads


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, bytes) of the segments of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, n)


def trained(words: list[bytes], y: np.ndarray, kinds: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 1) -> BiGru:
    """A network fitted to labelled segments by Adam; batches hold segments of one length."""
    net, rng = BiGru.fresh(kinds, hidden, seed), np.random.default_rng(seed)
    groups = [(at, x) for at, x in by_length(words)]
    first, second, step = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    for epoch in range(epochs):
        batches = []
        for g, (at, _) in enumerate(groups):
            mixed = rng.permutation(len(at))
            batches += [(g, mixed[i : i + BATCH]) for i in range(0, len(at), BATCH)]
        for b in rng.permutation(len(batches)):
            g, rows = batches[b]
            at, x = groups[g]
            _, grads = net.gradients(x[rows], y[at[rows]])
            step += 1
            scale = len(rows) / BATCH
            for k, grad in grads.items():
                grad = grad * scale
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                net.w[k] -= RATE / (1 + epoch) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows whose text never serves learning: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def spread_segments(text: str, most: int) -> list[bytes]:
    """At most ``most`` segments of a text, at even steps over the whole of it."""
    found = segments(text)
    step = max(1, -(-len(found) // most))
    return found[::step]


def sampler(most: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [spread_segments(t, most) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("mark"), pa.array(words, pa.list_(pa.binary()))], ["lang", "mark", "segments"])

    return sample


def sampled(docs: DataFrame, max_docs: int, max_langs: int, doc_segments: int, max_segments: int) -> DataFrame:
    """(lang, mark, segments): the training rows, bounded by the four numbers; of a language that has more than ``max_segments`` each row keeps the same share."""
    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    langs = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not langs:
        return docs.sparkSession.createDataFrame([], "lang string, mark long, segments array<binary>")
    # hashes below a bound of their language hold its least ``max_docs``: only these few rows are ordered
    few = F.lit(False)
    for lang, n in langs.items():
        few = few | ((F.col("lang") == lang) & least_hashes(F.col("mark"), max_docs, n))
    marks = learn.where(few).select("lang", "mark").distinct()
    first = marks.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("n") <= max_docs).select("lang", "mark")
    first = F.broadcast(written(first, "language-sample"))  # at most max_langs times max_docs rows
    rows = learn.where(few).join(first, ["lang", "mark"], "left_semi").dropDuplicates(["lang", "mark"])
    found = written(rows.select("lang", "text", "mark").mapInArrow(handing_back(sampler(doc_segments)), "lang string, mark long, segments array<binary>"), "language-segments")
    shares = found.groupBy("lang").agg(F.least(F.lit(1.0), max_segments / F.sum(F.size("segments"))).alias("share"))  # at most max_langs rows
    # even steps: those segments at which the share of the segments so far reaches the next whole number, the first always
    step = lambda i: F.ceil((i + 1) * F.col("share")) > F.ceil(i * F.col("share"))
    return found.join(F.broadcast(shares), "lang").select("lang", "mark", F.filter("segments", lambda _, i: step(i)).alias("segments"))


def sharpness(net: BiGru, rows: list[tuple[int, list[bytes]]]) -> float:
    """The factor on mean votes under which held-back documents (language, segments) are likeliest."""
    votes = []
    for _, words in rows:
        each = np.empty((len(words), len(net.w["c"])))
        for at, x in by_length(words):
            each[at] = net.votes(x)
        votes.append(each.mean(0))
    mean, y = np.array(votes), np.array([k for k, _ in rows])

    def loss(factor: float) -> float:
        z = factor * mean
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return min(SHARPNESS, key=loss) if len(rows) else 1.0


def fitted(docs: DataFrame, max_docs: int = MAX_DOCS, max_segments: int = MAX_SEGMENTS, max_langs: int = MAX_LANGS, doc_segments: int = DOC_SEGMENTS) -> tuple[list[str], BiGru | None, float]:
    """The learned languages, the network and the factor on mean votes."""
    rows = sorted((r["lang"], r["mark"], [bytes(w) for w in r["segments"]]) for r in sampled(docs, max_docs, max_langs, doc_segments, max_segments).collect())
    kinds = sorted({lang for lang, _, _ in rows})
    words, labels, kept_back = [], [], []
    for k, kind in enumerate(kinds):
        own = [(mark, found) for lang, mark, found in rows if lang == kind]
        back = [found for mark, found in own if mark % 4 == 0 and found] if len(own) >= 8 else []
        kept_back += [(k, found) for found in back]
        mine = [w for mark, found in own if not (back and mark % 4 == 0) for w in found]
        words += mine
        labels += [k] * len(mine)
    if len(kinds) < 2 or not words:
        return kinds, None, 1.0
    net = trained(words, np.array(labels), len(kinds))
    return kinds, net, sharpness(net, kept_back)


class Labeller:
    """Document labels from remembered votes of segments."""

    def __init__(self, kinds: list[str], weights: dict[str, np.ndarray] | None, factor: float = 1.0):
        self.kinds, self.net, self.factor = kinds, BiGru(weights) if weights else None, factor
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(kinds)), np.float32)

    def learn(self, texts: list[list[bytes]]) -> None:
        place = self.place
        new = list({w for words in texts for w in words if w not in place})
        if len(place) + len(new) > VOTE_MEMORY:
            place.clear()
            new = list({w for words in texts for w in words})
        start = len(place)
        if start + len(new) > len(self.table):
            self.table = np.concatenate((self.table[:start], np.zeros((start + 2 * len(new), len(self.kinds)), np.float32)))
        for at, x in by_length(new):
            for i in range(0, len(at), 2048):
                self.table[start + at[i : i + 2048]] = self.net.votes(x[i : i + 2048])
        place.update(zip(new, range(start, start + len(new)), strict=True))

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [t is not None and bool(LETTER.search(t)) and bool(self.kinds) for t in texts]
        if self.net is None:
            return [self.kinds[0] if x else UNKNOWN for x in lettered], [1.0 if x else 0.0 for x in lettered]
        cut = [segments(t) if x else [] for t, x in zip(texts, lettered, strict=True)]
        self.learn(cut)
        names, scores = [], []
        for words, x in zip(cut, lettered, strict=True):
            if not x:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].mean(0, dtype=np.float64)
            p = np.exp(self.factor * (mean - mean.max()))
            k = int(p.argmax())
            names.append(self.kinds[k])
            scores.append(float(p[k] / p.sum()))
        return names, scores


def identify_languages(docs: DataFrame, model: tuple[list[str], BiGru | None, float] | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` with ``held_out``, ``lang_pred`` and ``score``; ``model`` defaults to one fitted to ``docs``."""
    kinds, net, factor = model or fitted(docs)
    weights = docs.sparkSession.sparkContext.broadcast(net.w if net else None)
    added = ("held_out", "lang_pred", "score")
    others = [c for c in docs.columns if c.lower() not in added]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(kinds, weights.value, factor)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores = labeller.label(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*others, "lang_pred", "score"])

    return docs.select(*others).mapInArrow(handing_back(label), schema).withColumn("held_out", held_out(F.col("doc_id")))
