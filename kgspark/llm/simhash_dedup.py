"""Near-duplicates by SimHash and Golay-code fuzzy hashing.

Fingerprint: each bit is the majority of the XXH64 (seed 42) of all 3-word shingles of the lower-cased text.

Linking. Two fingerprints link if at most 2 of 64 bits differ. The bits are cut into segments of 23, 23 and 18.
At most 2 errors leave one of three segments without error (pigeonhole), and leave the next one with at most 2.
That segment is decoded by the perfect binary Golay code (23, 12): the codewords next to the segment and to its
23 neighbours number 1 or 6, and two words at a distance of 2 or less have one in common. A key is hence the
exact segment and one codeword index of the next: up to 18 keys for a fingerprint.

Verification. Keys are counted. A key of two fingerprints is one pair, whose bits are compared. Fingerprints of
keys with more are never paired: each is put at the 65 fingerprints within one bit of it, and those that meet at
one such centre are tied to the smallest there. Two fingerprints meet at a centre exactly if they differ in at
most 2 bits, so all links' connections are kept, and the work is linear in the size of a group.

Tables that grow with the documents are joined by sort and merge (hinted), never broadcast: their compressed
files would pass for smaller than they are. Components come by alternating stars. Copies are joined by fingerprint, as one node, before all this.

Null text and text without words: fingerprint 0, linked like any other. Rows of equal id each get a row. A
component of null ids only has a null id. Ties: a bit set in just half of the shingles is 0; components have one smallest id. Empty table: no rows.
Very long texts are taken whole: memory follows the longest text. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._components import components
from kgspark.llm._spark import kept, table
from kgspark.llm._words import NOT_SPACE, U, long_array, pieces, words

SHINGLE, SEED = 3, 42
#: XXH64's constants.
P1, P2, P3, P4, P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Generator of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of bytes."""
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data.data, strides=(1,))
    at, size = starts.astype(np.int64), (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(at), U(seed) + P5, U)
        far = np.flatnonzero(size >= 32)
        if len(far):
            v = [np.full(len(far), U(seed) + add, U) for add in (P1 + P2, P2, U(0), U(0) - P1)]
            place, left = at[far].copy(), size[far].copy()
            while (go := np.flatnonzero(left >= 32)).size:
                for i in range(4):
                    v[i][go] = _turn(v[i][go] + eight[place[go] + 8 * i] * P2, 31) * P1
                place[go] += 32
                left[go] -= 32
            x = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for y in v:
                x = (x ^ (_turn(y * P2, 31) * P1)) * P1 + P4
            h[far] = x
        at = at + (size & ~31)
        h += size.astype(U)
        left = size & 31
        for _ in range(3):
            go = np.flatnonzero(left >= 8)
            h[go] = _turn(h[go] ^ (_turn(eight[at[go]] * P2, 31) * P1), 27) * P1 + P4
            at[go] += 8
            left[go] -= 8
        go = np.flatnonzero(left >= 4)
        h[go] = _turn(h[go] ^ (four[at[go]].astype(U) * P1), 23) * P2 + P3
        at[go] += 4
        left[go] -= 4
        for _ in range(3):
            go = np.flatnonzero(left >= 1)
            h[go] = _turn(h[go] ^ (data[at[go]].astype(U) * P5), 11) * P1
            at[go] += 1
            left[go] -= 1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    w = words(texts, NOT_SPACE, True)
    n_docs, size = len(w.first) - 1, np.diff(w.first)
    # The words with one byte after each: a space, so that a shingle is a span of bytes.
    length = w.ends - w.starts
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1] if len(w) else np.empty(0, np.int64)
    joined = np.full(int(length.sum()) + len(w), 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[start + length] = False
    take = np.zeros(len(w.buf) + 1, np.int8)
    take[w.starts] = 1
    take[w.ends] -= 1
    joined[inside] = w.buf[np.cumsum(take[:-1]).astype(bool)]
    shingles = np.where(size >= shingle, size - shingle + 1, (size > 0).astype(size.dtype))
    first = np.concatenate([[0], np.cumsum(shingles)])
    at = np.repeat(w.first[:-1] - first[:-1], shingles) + np.arange(first[-1])
    last = np.minimum(at + shingle, np.repeat(w.first[1:], shingles)) - 1
    h = xxh64(joined, start[at], start[last] + length[last])
    # Bits are counted in bytes for up to 255 shingles at a time.
    blocks = -(-shingles // 255)
    total = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(n_docs, U)
    if not len(h):
        return out
    inner = np.arange(total[-1]) - np.repeat(total[:-1], blocks)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    part = np.add.reduceat(bits.view(U), np.repeat(first[:-1], blocks) + 255 * inner, axis=0).view(np.uint8)
    some = np.flatnonzero(shingles)
    counts = np.add.reduceat(part.astype(np.int32), total[:-1][some], axis=0)
    over = 2 * counts > shingles[some][:, None]
    out[some] = np.packbits(over, axis=1, bitorder="little").view(U).ravel()
    return out


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all words of 23 bits by byte, and the error of each remainder."""

    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    of_byte = np.array([[remainder(b << (8 * k)) if b << (8 * k) < 1 << 23 else 0 for b in range(256)] for k in range(3)], np.int64)
    error = np.zeros(2048, np.int64)
    places = range(23)
    for e in [0, *(1 << i for i in places), *(1 << i | 1 << j for i in places for j in range(i)), *(1 << i | 1 << j | 1 << k for i in places for j in range(i) for k in range(j))]:
        error[remainder(e)] = e
    return of_byte, error


def codewords(v: np.ndarray) -> np.ndarray:
    """The index of the codeword next to each word of 23 bits; none is further than 3 bits."""
    of_byte, error = _golay()
    left = of_byte[0][v & 255] ^ of_byte[1][v >> 8 & 255] ^ of_byte[2][v >> 16]
    return (v ^ error[left]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint its keys: (row, key)."""
    parts = [(prints >> U(s) & U((1 << 23) - 1)).astype(np.int64) for s in (0, 23, 46)]
    rows, keys = [], []
    for i in range(3):
        exact, fuzzy = parts[i], parts[(i + 1) % 3]
        near = np.sort(codewords(fuzzy[:, None] ^ np.array([0, *(1 << k for k in range(23))])), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append((i << 35) | (exact[row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _map_prints(df: DataFrame, make, column: str) -> DataFrame:
    """df: print. Rows print, <column>; make gives (row, value) of an array of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                prints = b.column(0).slice(at, 4096).to_numpy().view(U)
                row, value = make(prints)
                yield pa.RecordBatch.from_arrays([long_array(prints[row]), long_array(value)], ["print", column])

    return df.select("print").mapInArrow(run, f"print long, {column} long")


def _centres(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flips = np.concatenate([np.zeros(1, U), U(1) << np.arange(64, dtype=U)])
    return np.repeat(np.arange(len(prints)), 65), (prints[:, None] ^ flips).ravel()


def links(prints: DataFrame) -> DataFrame:
    """prints: print, each once. a, b: pairs of fingerprints of at most 2 differing bits that connect all that such pairs connect."""
    keys = _map_prints(prints, golay_keys, "key")
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).where("n > 1")
    counted = kept(counted, "keys")
    pairs = counted.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    crowded = counted.where("n > 2").select(F.col("key").alias("many"))
    crowd = keys.join(crowded.hint("merge"), F.col("key") == F.col("many")).select("print").distinct()
    at = _map_prints(kept(crowd, "crowd"), _centres, "centre")
    least = kept(at.groupBy("centre").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1").select(F.col("centre").alias("met"), "b"), "centres")
    tied = at.join(least.hint("merge"), F.col("centre") == F.col("met")).where("print > b").select(F.col("print").alias("a"), "b")
    return pairs.union(tied).distinct()


def simhash(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, print (long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), long_array(fingerprints(b.column("text")))], ["id", "print"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, print long").withColumnRenamed("id", id_col)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, print, component (the smallest id that links reach) of each row."""
    rows = kept(simhash(documents, id_col, text_col), "prints")
    nodes = kept(rows.groupBy("print").agg(F.min(id_col).alias("first")), "nodes")
    found = kept(components(links(nodes)), "roots")
    rooted = nodes.join(found.hint("merge"), F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("root"), "first")
    heads = kept(rooted.groupBy("root").agg(F.min("first").alias("component")), "heads")
    labels = kept(rooted.join(heads.hint("merge"), "root").select(F.col("print").alias("own"), "component"), "labels")
    return rows.join(labels.hint("merge"), F.col("print") == F.col("own")).select(id_col, "print", "component")


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
