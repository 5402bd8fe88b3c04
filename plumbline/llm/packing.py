"""Best-fit packing of token sequences by linear grouping.

Tokenising is per document. Everything global rests on the histogram of piece lengths, which has at most ``capacity``
rows whatever the corpus holds: the driver turns it into *runs*, each ``times`` sequences filled with the same lengths.

1. Large lengths (above ``capacity // small_share``) are sorted and cut into groups of equal cardinality; each is rounded
   up to the largest of its group.
2. The few rounded sizes are combined into configurations: again and again the configuration that fills the capacity
   best is found by dynamic programming and used as often as the groups allow.
3. Actual lengths take the places of the rounded ones, which splits a configuration into runs of equal lengths.
4. Small lengths, largest first, go where the least room is left that holds them; new sequences open when none has room.

Pieces are numbered within their length over all partitions (by shards, so that a frequent length is no single task's
work), and the pair (length, number) finds its run by binary search in the broadcast table of runs.

Null texts are empty; a document is its tokens and one end token, so none is without a piece. Rows that repeat an id are
packed each on its own. Extra columns are dropped.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import handing_back, light_batches, shuffle_partitions, written
from plumbline.llm.shingles import chunks

CAPACITY = 4096
END_ID = 1
GROUPS = 128
#: Lengths above capacity / SMALL_SHARE are large.
SMALL_SHARE = 4
#: Distinct words kept by a Python worker; beyond it, the memory starts anew.
WORD_MEMORY = 800_000
#: Bytes of text whose distinct words are looked up together.
CHUNK_BYTES = 8 << 20
#: ASCII marks that may close a word.
MARKS = string.punctuation
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"

_words: dict[str, dict[str, bytes]] = {}
#: Texts that tell whether a tokenizer takes each word between white space by itself, in lower case, and closing marks by themselves.
PROBES = ("Ab cD\tx.Y\n 12 A's\x0b\x0c\r\rZ", "one,two  three... Four!?", "\u00c9t\u00e9%%% STRASSE\u00df&& o''", "x @a.b-c_ 'll ## 1a2", " lead and trail ")


class WordIds:
    """Little-endian ids of texts from those of their distinct words between ASCII white space.

    A batch is split and dictionary-encoded by Arrow, so that a worker looks up each of its distinct words once. Unseen words are encoded many at a time, in
    one thread, as each core has a worker: a word's closing marks apart, and words of letters joined by spaces, as each ends with an end-of-word token.
    A tokenizer for which ``PROBES`` show that words don't stand by themselves gets whole texts instead.
    """

    def __init__(self, path: str, memory: int = WORD_MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = _words.setdefault(path, {})
        self.wordwise = all(self.encode([t])[0] == b"".join(self.encode([x for w in t.lower().split() for x in (w.rstrip(MARKS), w[len(w.rstrip(MARKS)) :]) if x])) for t in PROBES)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone."""
        joined = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # a letter that becomes more than letters in lower case
            return self.encode(words)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: list[str]) -> None:
        known, letters, rest, marked = self.known, set(), set(), []
        for w in words:
            core = w.rstrip(MARKS)
            if not core.isalpha():
                rest.add(w)
                continue
            if core not in known:
                letters.add(core)
            if len(core) < len(w):
                tail = w[len(core) :]
                marked.append((w, core, tail))
                if tail not in known:
                    rest.add(tail)
        for found, encode in ((list(letters), self.encode_letters), (list(rest), self.encode)):
            for i in range(0, len(found), 20_000):
                part = found[i : i + 20_000]
                known.update(zip(part, encode(part), strict=True))
        for w, core, tail in marked:
            known[w] = known[core] + known[tail]

    def texts(self, column: pa.Array) -> list[memoryview | bytes]:
        """The ids of each text of a string column without nulls."""
        if not self.wordwise:
            return self.encode(column.to_pylist())
        low = pc.ascii_lower(column)
        words = pc.ascii_split_whitespace(low)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > self.memory:
            known.clear()
            new = distinct
        self.learn(new)
        joined = pa.array(map(known.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        starts = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        bounds = (starts[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(joined) else np.zeros(len(column) + 1, np.int64)).tolist()
        data = memoryview(joined.buffers()[2] or b"")
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(pc.match_substring(low, "<|").to_numpy(zero_copy_only=False)).tolist():  # a special token's own text is cut out before anything else
            if any(s in low[i].as_py() for s in self.special):
                out[i] = self.encode([column[i].as_py()])[0]
        return out


def piece_maker(path: str, capacity: int, end_id: int, word_memory: int = WORD_MEMORY):
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path, word_memory)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                ids, rows = part.column(0).to_pylist(), []
                for doc_id, raw in zip(ids, words.texts(pc.fill_null(part.column(1), "")), strict=True):
                    n = len(raw) // 4 + 1
                    for k, i in enumerate(range(0, n, capacity)):
                        crc = zlib.crc32(raw[4 * i : 4 * (i + capacity)])
                        rows.append((doc_id, k, i, min(capacity, n - i), zlib.crc32(end, crc) if i + capacity >= n else crc))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def grouped(counts: np.ndarray, floor: int, groups: int) -> list[list[list[int]]]:
    """Large lengths, longest first, in groups of equal cardinality: each a list of [length, how many]."""
    total = int(counts[floor + 1 :].sum())
    per, out, room = max(1, -(-total // groups)), [], 0
    for length in range(len(counts) - 1, floor, -1):
        left = int(counts[length])
        while left:
            if not room:
                out.append([])
                room = per
            n = min(left, room)
            out[-1].append([length, n])
            left, room = left - n, room - n
    return out


def best_configuration(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size fill ``capacity`` best: a bounded knapsack, larger sizes preferred."""
    reach = np.full(capacity + 1, -1, dtype=np.int64)  # the last size used to reach a fill exactly
    reach[0] = len(sizes)
    for k, (size, n) in enumerate(zip(sizes, counts, strict=True)):
        for _ in range(min(n, capacity // size)):  # in the c-th round, fills with c of this size
            at = np.flatnonzero((reach[size:] < 0) & (reach[:-size] >= 0)) + size
            if not len(at):
                break
            reach[at] = k
    fill = int(np.flatnonzero(reach >= 0)[-1])
    out = [0] * len(sizes)
    while fill:
        k = int(reach[fill])
        out[k] += 1
        fill -= sizes[k]
    return out


def large_runs(counts: np.ndarray, floor: int, groups: int, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the sequences that hold the large lengths."""
    cut = grouped(counts, floor, groups)
    sizes, left = [g[0][0] for g in cut], [sum(n for _, n in g) for g in cut]
    runs: list[tuple[int, tuple[int, ...]]] = []
    while any(left):
        live = [k for k, n in enumerate(left) if n]
        # each sequence starts with the largest size left, as that has the fewest partners
        rest = best_configuration([sizes[k] for k in live], [left[k] - (i == 0) for i, k in enumerate(live)], capacity - sizes[live[0]]) if capacity > sizes[live[0]] else [0] * len(live)
        rest[0] += 1
        use = {k: c for k, c in zip(live, rest, strict=True) if c}
        times = min(left[k] // c for k, c in use.items())
        for k, c in use.items():
            left[k] -= times * c
        while times:  # actual lengths for rounded ones: as many sequences at once as have the same lengths
            taken, n = [], times
            for k, c in use.items():
                head = cut[k][0]
                if head[1] >= c:
                    taken.append((head[0],) * c)
                    n = min(n, head[1] // c)
                else:
                    n = 1
                    taken.append(())
            lengths = []
            for (k, c), same in zip(use.items(), taken, strict=True):
                lengths += same
                need = 0 if same else c
                if same:
                    cut[k][0][1] -= n * c
                while need:
                    part = min(need, cut[k][0][1])
                    lengths += [cut[k][0][0]] * part
                    cut[k][0][1] -= part
                    need -= part
                    if not cut[k][0][1]:
                        cut[k].pop(0)
                if cut[k] and not cut[k][0][1]:
                    cut[k].pop(0)
            runs.append((n, tuple(lengths)))
            times -= n
    return runs


def packed_runs(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of all sequences, for ``counts[length]`` pieces of each length up to ``capacity``."""
    counts = np.asarray(counts, dtype=np.int64).copy()
    floor = capacity // small_share
    by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    for n, lengths in large_runs(counts, floor, groups, capacity):
        by_room[capacity - sum(lengths)].append((n, tuple((x, 1) for x in lengths)))
    # small lengths, largest first, into the least room that holds them; several of one length at once where they fit
    rooms = np.zeros(capacity + 1, dtype=bool)
    rooms[[r for r in by_room if by_room[r]]] = True
    for length in range(min(floor, len(counts) - 1), 0, -1):
        left = int(counts[length])
        while left:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):
                by_room[capacity].append((-(-left // (capacity // length)), ()))
                rooms[capacity] = True
                continue
            room = int(fit[0]) + length
            n, held = by_room[room].pop()
            rooms[room] = bool(by_room[room])
            each = min(room // length, left)
            times = min(n, left // each)
            if times < n:
                by_room[room].append((n - times, held))
                rooms[room] = True
            by_room[room - each * length].append((times, (*held, (length, each))))
            rooms[room - each * length] = True
            left -= times * each
    return [(n, tuple(x for x, c in held for _ in range(c))) for held_runs in by_room.values() for n, held in held_runs if held]


def run_table(runs: list[tuple[int, tuple[int, ...]]], capacity: int) -> dict[str, np.ndarray]:
    """For each run and place in it: the lengths' numbers that it takes, its first sequence and its offset, sorted for search."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for times, lengths in runs:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"length": table[:, 0], "number": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def placer(runs):
    """Looks up (length, number) in the broadcast runs."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        # one sorted key for both columns: numbers stay below 2**50
        keys = table["length"] * (1 << 50) + table["number"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, length * (1 << 50) + number, side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(table["sequence"][at] + number - table["number"][at]), pa.array(table["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, word_memory: int = WORD_MEMORY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only where it is longer than ``capacity``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(handing_back(piece_maker(tokenizer_path, capacity, end_id, word_memory)), PIECES)


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, word_memory: int = WORD_MEMORY) -> DataFrame:
    """One row a piece of ``docs(doc_id, text, ...)``: PIECES with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    with light_batches(spark, rows=1000):  # whole texts pass the workers
        pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, word_memory), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    runs = spark.sparkContext.broadcast(run_table(packed_runs(counts, capacity, groups), capacity))

    shards = 4 * shuffle_partitions(spark)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    sizes = dealt.groupBy("length", "shard").count()
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("n", F.row_number().over(within) - 1).join(sizes.hint("merge"), ["length", "shard"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("n")).alias("number"))
    return numbered.mapInArrow(handing_back(placer(runs)), PLACED)
