"""Hidden Markov language model, trained by Baum-Welch counts aggregated across partitions.

A text is its lower-cased words and one end token. A latent state emits a *class* of words (by a hash of a word's last three bytes;
the end token has its own), and a class its words by their training counts: P(word | class) = (c + 1) / (N_class + V_class + 1). The
states are first fitted on the driver to a bounded sample: the ``INIT_DOCS`` distinct training texts of at most ``INIT_BYTES`` bytes with the least hashes; then ``ROUNDS`` rounds of
Baum-Welch run over all training texts: each task adds up the expected counts of its texts, Spark sums them over the tasks.
The likelihood of a text is exact: the scaled forward recursion over all its tokens. Texts are cut into blocks of
``BLOCK`` tokens whose transfer matrices are computed side by side and chained per text, so that a long text costs
no more a token than short ones.

Word counts are joined on a 64-bit word hash. Texts are dealt into chunks of bounded size; each chunk asks once for each of its distinct words.

Null and blank texts are the end token alone. Rows without an id are never held out. Rows that repeat an id are scored each on its own and
count each. With no training text all counts are 0. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import least_hashes, written
from plumbline.llm.shingles import chunks, mix, word_hashes, word_tails

STATES = 5
CLASSES = 1024
INIT_DOCS = 400
#: Bytes of a text in the sample at most: 50 MiB in all.
INIT_BYTES = 1 << 17
INIT_ROUNDS = 12
ROUNDS = 2
BLOCK = 64
#: Added to each expected count.
SMOOTH = 0.05
#: Bytes of text in a chunk on average.
CHUNK_BYTES = 6_000_000
END_CLASS = 0
#: Key of the end token, outside no word's reach but by a hash collision.
END_KEY = -7046029254386353131
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def word_classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, classes, first token of each text and the end) of a column of texts, end tokens included."""
    keys, bounds = word_hashes(column)
    tails = word_tails(column)
    of = (mix(tails, 21) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    n, docs = len(keys), len(bounds) - 1
    at = np.arange(n) + np.repeat(np.arange(docs), np.diff(bounds))
    ends = bounds[1:] + np.arange(docs)
    all_keys, all_classes = np.empty(n + docs, np.int64), np.empty(n + docs, np.int64)
    all_keys[at], all_classes[at] = keys.view(np.int64), of
    all_keys[ends], all_classes[ends] = END_KEY, END_CLASS
    return all_keys, all_classes, np.concatenate(([0], ends + 1))


class Blocks:
    """The tokens of several texts in blocks, longest first, and the chain of blocks of each text."""

    def __init__(self, classes: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        per = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), per)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = bounds[doc] + number * BLOCK
        length = np.minimum(BLOCK, bounds[doc + 1] - start)
        order = np.argsort(-length, kind="stable")
        self.start, self.length, self.opens, self.n_docs = start[order], length[order], (number == 0)[order], len(sizes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: for each step of a chain: the texts that have it and the places of their blocks
        by_step = np.argsort(number, kind="stable")
        self.chain = [(doc[s], place[s]) for s in np.split(by_step, np.cumsum(np.bincount(number))[:-1])] if len(doc) else []
        self.classes = classes
        steps = int(self.length[0]) if len(order) else 0
        self.active = [int(np.searchsorted(-self.length, -t, side="left")) for t in range(steps)]  # blocks longer than t

    def seen(self, t: int, n: int) -> np.ndarray:
        return self.classes[self.start[:n] + t]


class Model:
    """Start (K), transition (K x K) and class emission (K x C) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.of_class = np.ascontiguousarray(emit.T)

    @classmethod
    def from_counts(cls, counts: np.ndarray, states: int = STATES, classes: int = CLASSES) -> Model:
        start, move, emit = np.split(counts, [states, states + states * states])
        norm = lambda x: (x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True)
        return cls(norm(start), norm(move.reshape(states, states)), norm(emit.reshape(states, classes)))

    @classmethod
    def fresh(cls, shares: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
        """States that differ at random around the class shares, and tend to stay."""
        rng = np.random.default_rng(seed)
        emit = (shares + 1e-6) * rng.uniform(0.5, 1.5, (states, len(shares)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def transfers(self, b: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """(scaled transfer matrices, logarithms of their scales) of all blocks."""
        k, n = len(self.start), len(b.start)
        matrix, logs = np.repeat(np.eye(k)[None], n, 0), np.zeros(n)
        for t, m in enumerate(b.active):
            seen = self.of_class[b.seen(t, m)][:, None, :]
            if t:
                matrix[:m] = (matrix[:m].reshape(-1, k) @ self.move).reshape(m, k, k) * seen
            else:
                matrix[:m] = np.where(b.opens[:m, None, None], np.eye(k), self.move) * seen
            if t % 8 == 7 or t == len(b.active) - 1:
                scale = matrix.max((1, 2))
                matrix /= scale[:, None, None]
                logs += np.log(scale)
        return matrix, logs

    def forward(self, b: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood of each text, state before each block, transfer matrices)."""
        matrix, logs = self.transfers(b)
        at, total, before = np.repeat(self.start[None], b.n_docs, 0), np.zeros(b.n_docs), np.empty((len(b.start), len(self.start)))
        for docs, places in b.chain:
            before[places] = at[docs]
            after = np.einsum("bi,bij->bj", at[docs], matrix[places])
            scale = after.sum(1)
            at[docs] = after / scale[:, None]
            total[docs] += np.log(scale) + logs[places]
        return total, before, matrix

    def expected(self, b: Blocks) -> tuple[np.ndarray, float]:
        """(expected counts of starts, moves and emissions; log likelihood) of the texts: one Baum-Welch E step."""
        k, n = len(self.start), len(b.start)
        total, before, matrix = self.forward(b)
        after, at = np.empty((n, k)), np.ones((b.n_docs, k))
        for docs, places in reversed(b.chain):
            after[places] = at[docs]
            back = np.einsum("bij,bj->bi", matrix[places], at[docs])
            at[docs] = back / back.sum(1, keepdims=True)
        alphas, now = [], before.copy()
        for t, m in enumerate(b.active):
            moved = now[:m] @ self.move
            if t == 0:
                moved = np.where(b.opens[:, None][:m], now[:m], moved)
            moved *= self.of_class[b.seen(t, m)]
            now[:m] = moved / moved.sum(1, keepdims=True)
            alphas.append(now[:m].copy())
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, self.emit.shape[1]))
        beta, classes, gammas = after, [], []
        for t in range(len(b.active) - 1, -1, -1):
            m = b.active[t]
            gamma = alphas[t] * beta[:m]
            gamma /= gamma.sum(1, keepdims=True)
            seen = b.seen(t, m)
            classes.append(seen)
            gammas.append(gamma)
            forward = self.of_class[seen] * beta[:m]
            prior = alphas[t - 1][:m] if t else before[:m]
            inner = ~b.opens[:m] if t == 0 else slice(None)
            p, f = prior[inner], forward[inner]
            z = ((p @ self.move) * f).sum(1)
            move += self.move * ((p / z[:, None]).T @ f)
            if t == 0:
                start += gamma[b.opens[:m]].sum(0)
            back = forward @ self.move.T
            beta = beta.copy() if t == len(b.active) - 1 else beta
            beta[:m] = back / back.sum(1, keepdims=True)
        if classes:
            seen, gamma = np.concatenate(classes), np.concatenate(gammas)
            for i in range(k):
                emit[i] = np.bincount(seen, weights=gamma[:, i], minlength=emit.shape[1])
        return np.concatenate((start, move.ravel(), emit.ravel())), float(total.sum())


def held_out(doc_id: Column) -> Column:
    """Rows that serve no learning: crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, class, n) of the words of each chunk."""
    for batch in batches:
        for part in chunks(batch, "text", 4 << 20):
            keys, classes, _ = word_classes(part.column("text"))
            found, first, n = np.unique(keys, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(classes[first].astype(np.int32)), pa.array(n)], ["key", "class", "n"])


def expected_counts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, value): one task's expected counts, and last its log likelihood."""
        total = None
        for batch in batches:
            for part in chunks(batch, "text"):
                _, classes, bounds = word_classes(part.column("text"))
                counts, log = model.expected(Blocks(classes, bounds))
                counts = np.append(counts, log)
                total = counts if total is None else total + counts
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "value"])

    return run


def trained(texts: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """The model after local rounds on a bounded sample and ``rounds`` over all of ``texts(doc_id, text)``."""
    # hashes first, so that no task sends more than these to the driver
    mark, short = F.xxhash64("doc_id", "text").alias("_mark"), F.octet_length("text") <= INIT_BYTES
    rows = texts.agg(F.count("*").alias("all"), F.count_if(short).alias("short")).first()
    model = Model.fresh(shares, states)
    if not rows["all"]:
        return model
    few = short & least_hashes(F.xxhash64("doc_id", "text"), INIT_DOCS, rows["short"])
    chosen = F.broadcast(texts.where(few).select(mark).distinct().orderBy("_mark").limit(INIT_DOCS))
    sample = texts.where(few).select("text", mark).join(chosen, "_mark", "left_semi").dropDuplicates(["_mark"])
    column = pa.array([r["text"] for r in sorted(sample.collect(), key=lambda r: r["_mark"])], pa.string())
    if len(column):
        _, classes, bounds = word_classes(column)
        blocks = Blocks(classes, bounds)
        for _ in range(INIT_ROUNDS):
            model = Model.from_counts(model.expected(blocks)[0], states)
    size = states + states * states + states * CLASSES
    for _ in range(rounds):
        cells = texts.select("text").mapInArrow(expected_counts(model), "cell int, value double")
        counts = np.zeros(size + 1)
        for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # at most ``size + 1`` rows
            counts[r["cell"]] = r["value"]
        model = Model.from_counts(counts[:-1], states)
    return model


def ask_words(key: tuple, rows: pa.Table) -> pa.Table:
    """(chunk, key) of the distinct words of one chunk."""
    found = [np.unique(word_classes(part.column("text"))[0]) for batch in rows.combine_chunks().to_batches() for part in chunks(batch, "text", 4 << 20)]
    keys = np.unique(np.concatenate(found))
    return pa.table({"chunk": pa.array(np.full(len(keys), key[0].as_py(), np.int64)), "key": keys})


def scorer(model: Model, class_tokens: np.ndarray, class_words: np.ndarray):
    tokens, words = int(class_tokens.sum()), int(class_words.sum())
    of_class = -np.log10(class_tokens + class_words + 1.0)

    def score(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        """Scores of the texts of one chunk from the counts of its words."""
        order = np.argsort(counts["key"].to_numpy(), kind="stable")
        known, number = counts["key"].to_numpy()[order], counts["c"].to_numpy()[order]
        known, number = np.append(known, np.iinfo(np.int64).max), np.append(number, 0)
        out = []
        for batch in rows.combine_chunks().to_batches():
            for part in chunks(batch, "text"):
                keys, classes, bounds = word_classes(part.column("text"))
                at = np.searchsorted(known, keys)
                c = np.where(known[at] == keys, number[at], 0)
                add = lambda x: np.add.reduceat(x, bounds[:-1])
                log_c = np.log10(c + 1.0)
                base = add(log_c - np.log10(tokens + words + 1.0))
                hmm = model.forward(Blocks(classes, bounds))[0] / np.log(10)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds)), pa.array(add((c > 0).astype(np.int64)))]
                columns += [pa.array(np.full(len(base), tokens)), pa.array(base), pa.array(hmm + add(log_c + of_class[classes]))]
                out.append(pa.Table.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")]))
        return pa.concat_tables(out)

    return score


def hmm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """SCORED for each row of ``docs(doc_id, text, ...)``, learned from its rows that are not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    learn = texts.where(~F.col("held_out")).select("doc_id", "text")
    counts = learn.select("text").mapInArrow(count_words, "key long, class int, n long").groupBy("key", "class").agg(F.sum("n").alias("c"))
    counts = written(counts, "word-counts")
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # at most CLASSES rows
        class_tokens[r["class"]], class_words[r["class"]] = r["c"], r["v"]
    model = trained(learn, class_tokens / max(1.0, class_tokens.sum()), states, rounds)

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // CHUNK_BYTES))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    asked = dealt.groupBy("chunk").applyInArrow(ask_words, "chunk long, key long")
    given = asked.join(counts.select("key", "c").hint("merge"), "key").select("chunk", "key", "c")
    return dealt.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(scorer(model, class_tokens, class_words), SCORED)
