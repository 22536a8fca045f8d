"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and bytes beyond ASCII. The GRAM-word hashes of a text are its
grams; of each SPAN consecutive words the smallest gram hash (the last of equal ones) is kept. Since a window
of SPAN words has SPAN - GRAM + 1 grams, every shared window of SPAN words shares its kept gram, wherever it
stands: no shared span of SPAN words or more is missed. An item of fewer words is one window, kept by the hash
of all its words; documents are asked for such lengths as the items have.

Fingerprints of items and documents are joined. While items have at most MOST_PRINTS distinct ones (8 bytes
each), their sorted hashes are broadcast and documents are asked in the scan; beyond it the documents' distinct
fingerprints are joined by shuffle first. Hits are extended to their windows, which are compared word by word
with the items' windows (broadcast up to MOST_BYTES of words, else joined by shuffle), and windows that meet are
united to spans, by running maxima over rows. Which items have a window is a table of its own, one row for each, and met by shuffle only with windows that were
hit, once for each document: a window that all items share makes no large row, and no more rows than the result has ids.

Null or empty text: no words, no hits. Items of null id or without words take no part; items with equal id are
one item of several texts. Equal rows and null ids of documents each have a row of their own. Ties of gram hashes go to the last. Empty documents: no
rows; empty items: no hits. Very long texts are taken whole: memory follows the longest text. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._spark import kept, table
from kgspark.llm._words import ALNUM, U, grams, least, long_array, mix, pieces, window_starts, words

SPAN, GRAM, MOST_PRINTS, MOST_BYTES = 10, 5, 1_000_000, 8 << 20


def windows(texts: pa.Array, span: int, gram: int, short: tuple[int, ...], whole: bool):
    """The words, and of each width: (width, first words, fingerprints). whole: a short text is a window only as a whole."""
    w = words(texts, ALNUM, True)
    h = w.hashes()
    starts = window_starts(w, span)
    kept_gram = least(grams(h, gram), span - gram + 1)[starts]
    found = [(span, starts, grams(h, gram)[kept_gram])]
    size = np.diff(w.first)
    for n in short:
        at = window_starts(w, n)
        if whole:
            at = w.first[:-1][size == n]
        found.append((n, at, mix(grams(h, n)[at] ^ U(n))))
    return w, found


def item_windows(items: DataFrame, id_col: str, text_col: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """id (as text), width, print, words: the distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w, found = windows(b.column("text"), span, gram, tuple(range(1, span)), True)
            doc = w.doc
            for width, at, prints in found:
                text = [w.text(i, i + width).decode("utf-8", "replace") for i in at]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc[at])), pa.array(np.full(len(at), width, np.int32)), long_array(prints), pa.array(text, pa.string())], ["id", "width", "print", "words"])

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id string, width int, print long, words string").distinct()


def document_windows(rows: DataFrame, span: int, gram: int, short: tuple[int, ...], prints: np.ndarray | None) -> DataFrame:
    """rows: row, id, text (and asked, if prints is None: the fingerprints to look for). Adds n_words and the windows whose fingerprint is asked for."""
    shared = None if prints is None else rows.sparkSession.sparkContext.broadcast(prints)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("width", pa.int32()), ("print", pa.int64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w, found = windows(b.column("text"), span, gram, short, False)
            doc = w.doc
            hits: list[list[dict]] = [[] for _ in range(b.num_rows)]
            own = None if shared is not None else [set(x or ()) for x in b.column("asked").to_pylist()]
            for width, at, of in found:
                of = of.view(np.int64)
                if own is None:
                    place = np.searchsorted(shared.value, of)
                    good = np.flatnonzero(shared.value[np.minimum(place, len(shared.value) - 1)] == of) if len(shared.value) else []
                else:
                    good = [i for i, (d, p) in enumerate(zip(doc[at].tolist(), of.tolist(), strict=True)) if p in own[d]]
                for i in good:
                    d = doc[at[i]]
                    hits[d].append({"start": int(at[i] - w.first[d]), "width": width, "print": int(of[i]), "words": w.text(at[i], at[i] + width).decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(hits, kind)], ["row", "id", "n_words", "hits"])

    key = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {key}, n_words long, hits array<struct<start:int,width:int,print:long,words:string>>")


def document_prints(rows: DataFrame, span: int, gram: int, short: tuple[int, ...]) -> DataFrame:
    """row and each distinct fingerprint that its text keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w, found = windows(b.column("text"), span, gram, short, False)
            doc = w.doc
            for _, at, of in found:
                both = np.unique(np.stack([doc[at].astype(np.int64), of.view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(both[:, 0])), pa.array(both[:, 1])], ["row", "print"])

    return rows.mapInArrow(run, "row long, print long")


def contamination(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, most_prints: int = MOST_PRINTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id_col, n_words, hit_spans (array of first word, last word + 1; apart and in order), items (sorted texts of ids) of each row."""
    every = kept(item_windows(items, item_col, item_text_col, span, gram), "item-windows")
    known = kept(every.select("width", "print", "words").distinct(), "windows")
    short = tuple(r[0] for r in known.where(F.col("width") < span).select("width").distinct().collect())  # fewer than span numbers
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = known.select("print").distinct()
    n_windows, n_bytes = known.agg(F.count("*"), F.sum(F.octet_length("words") + 32)).first()
    if n_windows <= most_prints:
        asked = np.sort(np.array([r[0] for r in prints.collect()], np.int64))  # at most most_prints numbers
        found = document_windows(rows, span, gram, short, asked)
    else:
        rows = kept(rows, "rows")  # read twice: numbers must stay
        met = document_prints(rows, span, gram, short).join(kept(prints, "prints").hint("merge"), "print").groupBy("row").agg(F.collect_list("print").alias("asked"))
        found = document_windows(rows.join(met.hint("merge"), "row", "left"), span, gram, short, None)
    found = kept(found, "hits")
    at = found.select(F.col("row").alias("h_row"), F.explode("hits").alias("h")).select("h_row", "h.*")
    same = lambda k: (F.col("width") == F.col(f"{k}_width")) & (F.col("print") == F.col(f"{k}_print")) & (F.col("words") == F.col(f"{k}_words"))
    named = lambda df, k: df.select(*(F.col(c).alias(f"{k}_{c}") for c in df.columns))
    at = at.join(F.broadcast(named(known, "k")) if (n_bytes or 0) <= most_bytes else named(known, "k").hint("merge"), same("k"), "left_semi")
    at = kept(at.select("h_row", "start", (F.col("start") + F.col("width")).alias("end"), "width", "print", "words"), "true-hits")

    by_start = Window.partitionBy("h_row").orderBy("start", "end")
    far = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = at.select("h_row", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > far).cast("int"), F.lit(1)))
    spans = spans.withColumn("nth", F.sum("new").over(by_start)).groupBy("h_row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(F.col("h_row").alias("s_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))
    of = at.select("h_row", "width", "print", "words").distinct().join(named(every, "e").hint("merge"), same("e")).select("h_row", F.col("e_id").alias("item")).distinct()
    of = of.groupBy(F.col("h_row").alias("i_row")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = found.drop("hits").join(spans.hint("merge"), F.col("row") == F.col("s_row"), "left").join(of.hint("merge"), F.col("row") == F.col("i_row"), "left")
    no_spans, no_items = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("hit_spans", no_spans).alias("hit_spans"), F.coalesce("items", no_items).alias("items"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.expr("aggregate(hit_spans, 0L, (a, x) -> a + x.end - x.start)")
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""
