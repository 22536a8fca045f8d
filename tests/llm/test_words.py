import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from kgspark.llm import _words as W
from kgspark.llm.simhash_dedup import codewords, fingerprints, golay_keys, xxh64

TEXTS = ["", None, "a", "Aé b\tÉ c\n", "  x  ", "no-break here 1a_B", "\x00\x1fZ9", "日本 語", " ".join(f"w{i}" for i in range(50)), "\n"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_words():
    for kind, pattern, fold in ((W.NOT_SPACE, r"[^\x20\x09-\x0D]+", False), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = W.words(pa.array(TEXTS), kind, fold)
        for i, t in enumerate(TEXTS):
            t = lower(t or "") if fold else t or ""
            assert [w.text(j, j + 1).decode() for j in range(w.first[i], w.first[i + 1])] == re.findall(pattern, t)


def test_words_of_slices():
    column = pa.array(TEXTS).slice(3, 4)
    w = W.words(column, W.NOT_SPACE, False)
    assert np.diff(w.first).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in TEXTS[3:7]]
    assert len(W.words(pa.array([], pa.string()), W.NOT_SPACE, False)) == 0


def test_hashes_depend_on_the_word_only():
    w = W.words(pa.array(["a bc a", "bc", "ab c"]), W.NOT_SPACE, False)
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
    g = W.grams(W.words(pa.array(["x y z x y z"]), W.NOT_SPACE, False).hashes(), 2)
    assert g[0] == g[3] and g[1] == g[4] and g[0] != g[1]


def test_least_takes_the_last_of_equal_ones():
    v = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 13):
        expected = [max(j for j in range(i, i + width) if v[j] == v[i : i + width].min()) for i in range(len(v) - width + 1)]
        assert W.least(v, width).tolist() == expected
    assert len(W.least(v[:3], 5)) == 0


def test_pieces():
    batch = pa.record_batch([pa.array(["x" * n for n in (10, 0, 5, 100, 1)] + [None])], ["text"])
    got = list(W.pieces(iter([batch]), "text", 15))
    assert [b.num_rows for b in got] == [3, 1, 2]
    assert pa.Table.from_batches(got).column("text").to_pylist() == batch.column("text").to_pylist()


def test_xxh64():
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    start = np.arange(0, 4000)
    end = start + start % 131
    assert xxh64(data, start, end).tolist() == [xxhash.xxh64_intdigest(data[s:e].tobytes(), 42) for s, e in zip(start, end, strict=True)]


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_fingerprints():
    texts = [*TEXTS, "a b", "a b c", "q " * 1000 + "end", " ".join(str(i % 7) for i in range(600))]
    assert fingerprints(pa.array(texts)).tolist() == [brute_fingerprint(t or "") for t in texts]


def test_golay():
    rng = random.Random(3)
    words = np.array([rng.randrange(1 << 23) for _ in range(500)])
    for v in words.tolist():
        ball = lambda x: set(codewords(np.array([x, *(x ^ 1 << k for k in range(23))])).tolist())
        near = v ^ 1 << rng.randrange(23) ^ 1 << rng.randrange(23)
        assert len(ball(v)) in (1, 6) and ball(v) & ball(near)


def test_keys_meet_within_two_bits():
    rng = random.Random(4)
    for _ in range(200):
        a = rng.randrange(1 << 64)
        b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        rows, keys = golay_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
