"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words and in the beginnings of its words
(HEADS bytes, as inflected words differ at the end), all hashed to 2**BITS weights; a document's score is the noisy-or of its sentences, 1 - prod(1 - p).
Only document labels are known: the likelihood of the noisy-or is ascended, which credits those sentences
that explain the label. Sentences of a score of 0.5 or more are the offending ones.

Fitting uses at most `sample` labelled documents (SAMPLE by default: those of the smallest hashes), and of these, in that order, no more than
`most_bytes` of text (SAMPLE_BYTES by default; one document at least), as the
one bounded part; of documents of one id, that of the smallest hash; features in fewer than MIN_DOCS of them have weight 0. Every row is scored on its whole text.

Null or empty text, or one without words: score 0, no offending sentence. Labels that are null, or of ids
without a document, are not used; of several labels of one id the largest holds. With no usable label, or only
one class, all scores are 0 or stem from the bias alone. Equal rows are scored alike, one row each; empty table: no rows. Very long texts are
scored whole. Ties: a score of 0.5 counts as toxic. Other columns are not read, or kept in a struct, so their names may clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._spark import table
from kgspark.llm._words import ALNUM, U, Words, _bytes, mix, pieces, prefix, spans, words

BITS, SAMPLE, SAMPLE_BYTES, MIN_DOCS, HEADS = 18, 16_384, 64 << 20, 5, (4, 5)
EPOCHS, STEPS, BATCH, RATE, RIDGE, LASSO, PRIOR = 15, 800, 128, 0.05, 2e-5, 2e-4, -8.0
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True  # a line's end and !.?


def features(w: Words, bits: int = BITS) -> list[np.ndarray]:
    """For each word, the weight indexes of the word and of its beginnings (of a shorter word, salted)."""
    sums = prefix(w.buf.astype(U) + U(1), _bytes)
    hashes = [mix(spans(sums, w.starts, w.ends, _bytes))]
    hashes += [mix(spans(sums, w.starts, np.minimum(w.starts + n, w.ends), _bytes) + U(n * 0xA5A5A5A5A5A5A5A5 % (1 << 64))) for n in HEADS]
    return [(h >> U(64 - bits)).astype(np.int32) for h in hashes]


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each sentence, and each sentence's document. A sentence has a word at least."""
    ended = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(ENDS[w.buf], out=ended[1:])
    number = ended[w.starts] + w.doc
    first = np.flatnonzero(np.diff(number, prepend=-1))
    return first, w.doc[first]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sentence_logits(model: tuple[np.ndarray, float], indexes: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    weights, bias = model
    return bias + (np.add.reduceat(sum(weights[i] for i in indexes), first) if len(first) else np.empty(0))


def fit(texts: pa.Array, toxic: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Adam over small batches of documents, in an order that depends on nothing but their number."""
    size = 1 << bits
    seen = np.zeros(size, np.int32)
    parts, n_words, n_docs = [], 0, 0
    # Piece by piece: what stays of a piece is a few numbers of 4 bytes for a word.
    for piece in pieces([pa.record_batch([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], ["text"])], "text", 1 << 20):
        w = words(piece.column(0), ALNUM, True)
        indexes = features(w, bits)
        for f in indexes:
            pairs = np.unique(w.doc.astype(np.int64) * size + f)
            seen += np.bincount(pairs & (size - 1), minlength=size).astype(np.int32)
        first, of = sentences(w)
        parts.append((*indexes, first + n_words, of + n_docs))
        n_words, n_docs = n_words + len(w), n_docs + piece.num_rows
    if not parts:
        return np.zeros(size), PRIOR
    *indexes, first, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    used = (seen >= MIN_DOCS).astype(np.float64)
    begin = np.searchsorted(of, np.arange(len(toxic) + 1))  # sentences of each document
    bounds = np.append(first, n_words)
    weights, bias = np.zeros(size), PRIOR
    m, v, mb, vb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    draw = np.random.default_rng(7)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(toxic)))):
        order = draw.permutation(len(toxic))
        for at in range(0, len(order), BATCH):
            ids = np.sort(order[at : at + BATCH])
            s = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in ids])
            if not len(s):
                continue
            n = np.diff(bounds)[s]
            cut = np.concatenate([[0], np.cumsum(n)[:-1]])
            tokens = np.repeat(first[s] - cut, n) + np.arange(n.sum())
            own = [i[tokens] for i in indexes]
            z = sentence_logits((weights, bias), own, cut)
            place = np.searchsorted(ids, of[s])
            total = np.bincount(place, softplus(z), len(ids))
            slope = np.where(toxic[ids] > 0, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0) / len(ids)
            g = slope[place] / (1 + np.exp(-np.maximum(z, -60)))
            per = np.repeat(g, n)
            grad = sum(np.bincount(i, per, size) for i in own) * used + RIDGE * weights
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            weights = weights - RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - RATE * LASSO / (np.sqrt(v / c2) + 1e-8), 0)  # chance words of few documents go back to 0
            bias -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return weights, float(bias)


def score(model: tuple[np.ndarray, float], texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Each document's score, and its offending sentences as spans of code points."""
    w = words(texts, ALNUM, True)
    n = len(w.first) - 1
    first, of = sentences(w)
    z = sentence_logits(model, features(w), first)
    scores = -np.expm1(-np.bincount(of, softplus(z), n)) if len(of) else np.zeros(n)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    bad = np.flatnonzero(z >= 0)
    if len(bad):
        points = np.zeros(len(w.buf) + 1, np.int64)
        np.cumsum((w.buf & 0xC0) != 0x80, out=points[1:])
        last = np.append(first[1:], len(w)) - 1
        for s in bad:
            zero = points[w.offsets[of[s]]]
            found[of[s]].append((int(points[w.starts[first[s]]] - zero), int(points[w.ends[last[s]]] - zero)))
    return np.clip(scores, 0.0, 1.0), found


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Weights and bias. learn: which label rows may be used."""
    rows = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where(F.col("label_id").isNotNull() & F.col("y").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    order = F.xxhash64(F.lit(3), "label_id")
    rows = rows.groupBy("label_id").agg(F.max("y").alias("y")).orderBy(order, "label_id").limit(sample)
    # No more than `sample` rows of two numbers: broadcast whatever the input's size.
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("own"), F.col(text_col).cast("string").alias("text"))
    sizes = texts.join(F.broadcast(rows), F.col("id") == F.col("label_id")).groupBy("label_id", "y").agg(F.min(F.struct("own", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))).alias("text"))
    spark, left, chosen = documents.sparkSession, most_bytes, []
    for r in sizes.select("label_id", "y", "text.own", "text.n", order.alias("at")).sort("at", "label_id").collect():  # `sample` rows of numbers at most
        if left < r["n"] and chosen:
            break
        left -= r["n"]
        chosen.append((r["label_id"], r["y"], r["own"]))
    picks = spark.createDataFrame(chosen, f"label_id {rows.schema['label_id'].dataType.simpleString()}, y int, picked long")
    picked = texts.join(F.broadcast(picks), (F.col("id") == F.col("label_id")) & (F.col("own") == F.col("picked"))).select("id", "y", "text").dropDuplicates(["id"]).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = t.sort_by([("id", "ascending"), ("y", "ascending")])
        weights, bias = fit(t.column("text"), t.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(weights.astype(np.float32).tobytes(), 1)]), pa.array([bias])], ["weights", "bias"])

    made = picked.mapInArrow(run, "weights binary, bias double").collect()  # one row of a fixed size
    if not made:
        return np.zeros(1 << BITS, np.float32), -1e9
    return np.frombuffer(zlib.decompress(made[0]["weights"]), np.float32), made[0]["bias"]


def toxicity(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, score, predicted, offending (array of start, end) of each row. With keep, a struct `kept` of those columns stands for id_col."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "scored_text"):
            scores, found = score(shared.value, b.column("scored_text"))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            offending = pa.array([[{"start": s, "end": e} for s, e in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), offending], [b.schema.names[0], "score", "predicted", "offending"])

    first = F.col(id_col).alias("id") if keep is None else F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")
    rows = documents.select(first, F.col(text_col).cast("string").alias("scored_text"))
    out = rows.mapInArrow(run, f"{rows.columns[0]} {rows.schema[0].dataType.simpleString()}, score double, predicted int, offending array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col) if keep is None else out


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"), learn=~held_out("label_id"))
    out = toxicity(documents, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
