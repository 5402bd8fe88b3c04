import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm.packing import WordIds, best_configuration, best_fit_pack, packed_runs

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_runs(counts, capacity, **kwargs):
    runs = packed_runs(counts, capacity, **kwargs)
    used = np.zeros(len(counts), dtype=int)
    for times, lengths in runs:
        assert times > 0 and 0 < sum(lengths) <= capacity
        for x in lengths:
            used[x] += times
    assert (used == counts).all()
    return sum(n for n, _ in runs)


def test_runs_use_every_piece_once_and_stay_near_the_bound():
    rng = np.random.default_rng(0)
    for n, shape in ((0, 1), (1, 1), (50, 2), (3000, 0.7), (3000, 3)):
        lengths = np.clip(rng.gamma(shape, 300, n).astype(int), 1, 4096)
        counts = np.bincount(lengths, minlength=4097)
        bins = check_runs(counts, 4096)
        least = -(-lengths.sum() // 4096) if n else 0
        assert least <= bins <= 1.02 * least + 1


def test_hot_length_and_full_pieces():
    counts = np.zeros(4097, dtype=int)
    counts[4096], counts[1365], counts[1] = 100, 3000, 999
    assert check_runs(counts, 4096) == 100 + 1000
    counts = np.zeros(11, dtype=int)
    counts[7], counts[3], counts[10] = 5, 5, 2
    assert check_runs(counts, 10, groups=12, small_share=4) == 7


def test_configuration_respects_counts():
    assert best_configuration([7, 5, 3], [1, 2, 1], 10) == [1, 0, 1] or best_configuration([7, 5, 3], [1, 2, 1], 10) == [0, 2, 0]
    assert best_configuration([6], [5], 10) == [1]


def test_pack_round_trip(spark):
    texts = {0: "Hello the world's end", 1: None, 2: "", 3: "the and of " * 5000, 4: "A\x1cb \x85 c d é<|endoftext|>x ́z", 5: "Ünïcode ΣΑΣ İ", 6: "same", 7: "same"}
    texts |= {100 + i: "word " * (i % 37 + 1) for i in range(300)}
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()] + [(6, "same", "x", 1)], "doc_id long, text string, piece string, offset int")
    rows = best_fit_pack(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for k, v in [*texts.items(), (6, "same")]:
        ids = [*t.encode(v or "", add_special_tokens=False).ids, 1]
        for p, i in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[i : i + 4096], "<u4")
            want.append((k, p, i, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want) == sorted(tuple(r)[:5] for r in rows)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
    assert len(filled) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_empty_table(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


TRICKY = ["İstanbul İ x", "ΣΑΣ Σ", "áb é é", "don't 's 'S I'LL x'd. ab.'t it's's 're.'re", "<|endoftext|> hi <|ENDOFTEXT|> a<|b", "a b c\u0085d", "12ab 3.4 ½ ²", "́x", "ﬁ Å K Ω", "日本語、テスト。", "x..'s x' ' w***.", "", " ", "\n\n", "a\x00b \x1c \x1f c", "word " * 3000]


def test_word_ids_are_the_library_s():
    words = WordIds(PATH)
    assert words.wordwise
    got = [bytes(x) for x in words.texts(pa.array(TRICKY))]
    assert got == words.encode(TRICKY) == [bytes(x) for x in words.texts(pa.array(["skipped", *TRICKY]).slice(1))]


def test_a_tokenizer_that_joins_words_gets_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")  # keeps case and spaces
    words = WordIds(other)
    assert not words.wordwise
    assert [bytes(x) for x in words.texts(pa.array(TRICKY))] == words.encode(TRICKY)
