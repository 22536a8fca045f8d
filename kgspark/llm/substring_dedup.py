"""Substring deduplication with a log-structured fingerprint index.

A window is WIDTH consecutive words of one document; it is removed if the same words start earlier: in a smaller
id, or before in the same document, or in an older batch. Words that a removed window covers go.

Fingerprints. Of the GRAM-word hashes of a window the smallest (the last of equal ones) is its anchor; equal
windows have equal anchors, at the same place in them. The windows that share an anchor's place in a document
are neighbours and form a block. A block's row is the anchor's hash, the hash of the block's words and its windows (the anchor's place
in the first, and 40 bits of each window's hash): one row for about eight words instead of one for each word.

Index. A run is an immutable Parquet table of blocks, bucketed and sorted by anchor and block. A new batch's blocks are pre-aggregated,
shuffled once to the same buckets and sorted; from there each run is merge-joined with them, bucket by bucket: no run is
shuffled or sorted again, and no older text is read. They then are a new run as they lie. Beyond FANOUT runs, the two neighbours of the fewest batches are merged to one,
again bucket by bucket, which has each block once. Of a batch's blocks
*   one that a run has, or that a smaller id has, is removed: all its windows occurred before;
*   the first of a block whose anchor has other blocks, here or in runs, is verified;
*   other firsts stay: none of their windows occurred before.

Verification. Windows of the second kind, and of runs' blocks at the same anchors, are compared one by one, by anchor, place in it
and hash (64 and 40 bits); the earliest of each stays. A removal is carried out
only on a row whose words have the hash in question at that place, so that rows of equal id but other text are
told apart.

Hot anchors and blocks: a block's copies meet in a partial aggregate; batch rows are joined by sort and merge, whose partitions Spark can
split. A run keeps a block once.

Null text: no words. Null ids: after all others, in the order of a hash of their texts. Rows of equal id (and null
ids of equal text) start equally early, and thus do not remove each other; equal rows have equal results. Empty table or batch: no rows, and
an empty run. Very long texts are taken whole: memory follows the longest text. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm._spark import drop_path, kept, scratch, store, table, tidy
from kgspark.llm._words import NOT_SPACE, U, block_hashes, grams, least, long_array, mix, pieces, window_starts, words

WIDTH, GRAM, FANOUT, BATCHES, BUCKET_BYTES = 20, 6, 2, 4, 24 << 20
BITS = 40  # of a window's hash
ROWS = "anchor long, block long, id long, place long, windows binary, again boolean"
LAST = (1 << 63) - 1  # null ids stand before it, by 31 bits of their text's hash


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return documents.select(F.coalesce(own, F.lit(LAST) - F.shiftrightunsigned(F.xxhash64(text), 33)).alias("id"), own.isNull().alias("no_id"), text.alias("text"))


def blocks_of(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """rows: id, text. A row for each block; place is the first word << 8 | number of words beyond width; again: the text has had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = words(b.column("text"), NOT_SPACE, False)
            starts = window_starts(w, width)
            if not len(starts):
                continue
            h = w.hashes()
            g = grams(h, gram)
            anchor = least(g, width - gram + 1)[starts]
            doc = w.doc[starts]
            new = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(doc, prepend=-1))
            size = np.diff(new, append=len(starts))
            begin, end = starts[new], starts[new + size - 1] + width
            place = (begin - w.first[doc[new]]) << 8 | (end - begin - width)
            blocks = block_hashes(h, begin, end)
            first = np.unique(mix(blocks ^ mix(g[anchor[new]])) ^ mix(doc[new].astype(U)), return_index=True)[1]
            again = np.ones(len(new), bool)
            again[first] = False
            # A byte for the anchor's place in the first window, and BITS of each window.
            nth = np.repeat(np.arange(len(new)), size)
            data = np.zeros(len(new) + len(starts) * (BITS // 8), np.uint8)
            ends = np.concatenate([[0], np.cumsum(1 + size * (BITS // 8))])
            data[ends[:-1]] = anchor[new] - begin
            at = np.arange(len(starts)) * (BITS // 8) + nth + 1
            data[at[:, None] + np.arange(BITS // 8)] = block_hashes(h, starts, starts + width).view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
            windows = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [long_array(g[anchor[new]]), long_array(blocks), b.column("id").take(pa.array(doc[new])), pa.array(place), windows, pa.array(again)], ["anchor", "block", "id", "place", "windows", "again"]
            )

    return rows.select("id", "text").mapInArrow(run, ROWS)


def _windows(rows: DataFrame) -> DataFrame:
    """rows: anchor, id, place, windows. anchor, at (the anchor's place in it), window, id, place of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("windows")
            offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
            size = (np.diff(offsets) - 1) // (BITS // 8)
            row = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = (offsets[:-1][row] + 1 + nth * (BITS // 8))[:, None] + np.arange(BITS // 8)
            value = np.zeros((len(row), 8), np.uint8)
            value[:, : BITS // 8] = data[at]
            take = pa.array(row)
            place = (b.column("place").to_numpy()[row] >> 8) + nth << 8
            in_it = data[offsets[:-1][row]].astype(np.int32) - nth.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(take), pa.array(in_it), pa.array(value.view(np.int64).ravel()), b.column("id").take(take), pa.array(place)], ["anchor", "at", "window", "id", "place"])

    return rows.select("anchor", "id", "place", "windows").mapInArrow(run, "anchor long, at int, window long, id long, place long")


def _span(path: str) -> tuple[int, int]:
    """The first and the last batch of a run."""
    _, first, last, _ = path.rpartition("/")[2].split("-")
    return int(first), int(last)


class FingerprintIndex:
    """The runs under a path of the shared folder. One writer at a time; a run appears when its write has succeeded. buckets: of a new index; one that is found keeps its own."""

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH, gram: int = GRAM, fanout: int = FANOUT, buckets: int = 8):
        self.spark, self.path, self.width, self.gram, self.fanout, self.buckets = spark, path.rstrip("/"), width, gram, fanout, buckets
        self.runs: list[str] = []
        self.names: list[str] = []  # of tables that are read, until a batch is settled
        self.batch = 0
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        hadoop = jvm.Path(self.path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hadoop):
            # run-<first batch>-<last batch>-<buckets>; runs that a merged one has taken in may still be there.
            names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("run-") and fs.exists(jvm.Path(s.getPath(), "_SUCCESS")))
            spans = {n: _span(n) for n in names}
            self.runs = [f"{self.path}/{n}" for n, (a, z) in spans.items() if not any(x <= a and z <= y and (x, y) != (a, z) for x, y in spans.values())]
            self.batch = max((z for _, z in spans.values()), default=0)
            self.buckets = int(names[-1].rpartition("-")[2]) if names else buckets

    @property
    def scratch(self) -> str:
        """Where a batch's own tables are until it is settled."""
        return f"{self.path}-batch"

    @contextlib.contextmanager
    def merging(self) -> Iterator[None]:
        """Within it, plans use the runs' order (a bucket is one file), and buckets by anchor serve joins by anchor and block."""
        names = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
        before = {n: self.spark.conf.get(n) for n in names}
        for n, v in names.items():
            self.spark.conf.set(n, v)
        try:
            yield
        finally:
            for n, v in before.items():
                self.spark.conf.set(n, v)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        with self.merging():
            store(df, f"{self.scratch}/{name}", "overwrite")
        return self.spark.read.schema(df.schema).parquet(f"{self.scratch}/{name}")

    def _bucketed(self, df: DataFrame, path: str) -> None:
        """Writes df, whose rows lie in buckets by anchor."""
        name = f"kgspark_{uuid.uuid4().hex}"
        with tidy(self.spark), self.merging():
            df.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor", "block").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _read(self, path: str, schema: str) -> DataFrame:
        """A bucketed table. Its files are in order, one for a bucket, so that merging needs neither shuffle nor sort."""
        name = f"kgspark_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, block) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.names.append(name)
        return self.spark.table(name)

    def run(self, path: str) -> DataFrame:
        return self._read(path, "anchor LONG, block LONG, windows BINARY")

    def merge(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """rows: id, text. Merges a batch with the runs. Its blocks; of blocks that are to be removed or verified somewhere: anchor, block, least (the smallest id), known (a run has it), several (its anchor has others); the runs' blocks at the batch's anchors."""
        self.batch += 1
        drop_path(self.spark, self.scratch)  # of a batch that was not settled
        every = self.stored(blocks_of(rows, self.width, self.gram), "blocks")
        firsts = every.groupBy("anchor", "block", "windows").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        # Buckets are Spark's own hash partitions; one task writes each.
        self._bucketed(firsts.repartition(self.buckets, "anchor"), f"{self.scratch}/firsts")
        firsts = self.firsts()
        anchors = firsts.groupBy("anchor").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        met = None
        for path in self.runs:
            own = self.run(path).join(anchors.select(F.col("anchor").alias("met")).hint("merge"), F.col("anchor") == F.col("met"), "left_semi")
            met = own if met is None else met.union(own)
        if met is None:
            met = self.spark.createDataFrame([], "anchor long, block long, windows binary")
        met = self.stored(met, "met")
        older = met.groupBy(F.col("anchor").alias("o_anchor")).agg(F.min("block").alias("o_low"), F.max("block").alias("o_high"))
        several = anchors.join(older.hint("merge"), F.col("anchor") == F.col("o_anchor"), "left").where(F.least("low", "o_low") != F.greatest("high", "o_high")).select(F.col("anchor").alias("s_anchor"))
        known = met.select(F.col("anchor").alias("k_anchor"), F.col("block").alias("k_block")).distinct()
        marked = firsts.join(known.hint("merge"), (F.col("anchor") == F.col("k_anchor")) & (F.col("block") == F.col("k_block")), "left").join(several.hint("merge"), F.col("anchor") == F.col("s_anchor"), "left")
        marked = marked.select("anchor", "block", "least", "n", F.col("k_block").isNotNull().alias("known"), F.col("s_anchor").isNotNull().alias("several"))
        return every, self.stored(marked.where("n > 1 or known or several").drop("n"), "marked"), met

    def firsts(self) -> DataFrame:
        """The batch's blocks, each once, with the smallest id that has it and how many rows have."""
        return self._read(f"{self.scratch}/firsts", "anchor LONG, block LONG, windows BINARY, least LONG, n LONG")

    def settle(self) -> None:
        """Ends a batch, when its results are written: its blocks become a run, its other tables go, and runs are merged when there are too many."""
        path = f"{self.path}/run-{self.batch:06d}-{self.batch:06d}-{self.buckets}"
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = jvm.Path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(jvm.Path(self.path))
        if not fs.rename(jvm.Path(f"{self.scratch}/firsts"), jvm.Path(path)):
            raise OSError(f"cannot move a batch's blocks to {path}")
        self.runs.append(path)
        drop_path(self.spark, self.scratch)
        while len(self.runs) > self.fanout:
            self.compact()
        while self.names:
            self.spark.sql(f"DROP TABLE {self.names.pop()}")

    def compact(self) -> None:
        """Merges two neighbouring runs, those of the fewest batches, to one, which has each of their blocks once."""
        spans = [_span(p) for p in self.runs]
        i = min(range(len(spans) - 1), key=lambda i: spans[i + 1][1] - spans[i][0])
        path = f"{self.path}/run-{spans[i][0]:06d}-{spans[i + 1][1]:06d}-{self.buckets}"
        one, two = self.run(self.runs[i]), self.run(self.runs[i + 1]).select(F.col("anchor").alias("b_anchor"), F.col("block").alias("b_block"), F.col("windows").alias("b_windows"))
        rows = one.join(two.hint("merge"), (F.col("anchor") == F.col("b_anchor")) & (F.col("block") == F.col("b_block")), "full_outer")
        self._bucketed(rows.select(F.coalesce("anchor", "b_anchor").alias("anchor"), F.coalesce("block", "b_block").alias("block"), F.coalesce("windows", "b_windows").alias("windows")), path)
        for p in self.runs[i : i + 2]:
            drop_path(self.spark, p)
        self.runs[i : i + 2] = [path]


def removals(index: FingerprintIndex, rows: DataFrame) -> DataFrame:
    """Judges a batch. rows: id, text. id, place, check: the blocks to remove; place as in blocks_of, check: BITS of the hash of what stands there."""
    every, marked, met = index.merge(rows)
    cut = lambda c: F.col(c).bitwiseAND(F.lit((1 << BITS) - 1)).alias("check")
    marked = marked.withColumnRenamed("anchor", "m_anchor").withColumnRenamed("block", "m_block")
    own = every.where("not again").select("anchor", "block", "id", "place").join(marked.hint("merge"), (F.col("anchor") == F.col("m_anchor")) & (F.col("block") == F.col("m_block")))
    own = index.stored(own.select("anchor", "block", "id", "place", (~F.col("known") & (F.col("id") == F.col("least"))).alias("first"), "several"), "own")
    again = every.where("again").select("id", "place", "block").union(own.where("not first").select("id", "place", "block"))
    asked = own.where("several and first").select(F.col("anchor").alias("a_anchor"), F.col("block").alias("a_block"), "id", "place")
    asked = index.firsts().join(asked.hint("merge"), (F.col("anchor") == F.col("a_anchor")) & (F.col("block") == F.col("a_block")))
    new = index.stored(_windows(asked.select("anchor", "id", "place", "windows")).distinct(), "windows")
    anchors = new.select(F.col("anchor").alias("n_anchor")).distinct()
    old = _windows(met.join(anchors.hint("merge"), F.col("anchor") == F.col("n_anchor"), "left_semi").select("anchor", F.lit(-1 << 63).alias("id"), F.lit(0).cast("long").alias("place"), "windows"))
    # What runs hold has the least of all ids.
    first = new.union(old).groupBy(F.col("anchor").alias("f_anchor"), F.col("at").alias("f_at"), F.col("window").alias("f_window")).agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = index.stored(first, "window-firsts")
    late = new.join(first.hint("merge"), (F.col("anchor") == F.col("f_anchor")) & (F.col("at") == F.col("f_at")) & (F.col("window") == F.col("f_window"))).where(F.struct("id", "place") != F.col("first"))
    return again.select("id", "place", cut("block")).union(late.select("id", "place", cut("window")))


def _asked(w, h: np.ndarray, column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks asked for, those that a row has: first word, end, row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    place, check = flat.field("place").to_numpy(), flat.field("check").to_numpy()
    begin = w.first[row] + (place >> 8)
    end = begin + width + (place & 255)
    there = np.flatnonzero(end <= w.first[row + 1])
    there = there[(block_hashes(h, begin[there], end[there]) & U((1 << BITS) - 1)).view(np.int64) == check[there]]
    return begin[there], end[there], row[there]


def dedup(documents: DataFrame, index: FingerprintIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256 of each row of a new batch. When this is written, settle the index."""
    rows, width = _rows(documents, id_col, text_col), index.width
    gone = removals(index, rows)
    gone = gone.groupBy("id").agg(F.collect_list(F.struct("place", "check")).alias("asked")).withColumnRenamed("id", "asked_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = words(b.column("text"), NOT_SPACE, False)
            step = np.zeros(len(w) + 1, np.int64)
            if b.column("asked").null_count < b.num_rows:
                begin, end, _ = _asked(w, w.hashes(), b.column("asked"), width)
                np.add.at(step, begin, 1)
                np.add.at(step, end, -1)
            stays = np.cumsum(step[:-1]) == 0
            size = np.diff(w.first)
            n_kept = np.add.reduceat(np.append(stays, 0).astype(np.int64), w.first[:-1]) * (size > 0) if len(size) else size
            raw, starts, ends = w.buf.tobytes(), w.starts[stays].tolist(), w.ends[stays].tolist()
            kept_words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
            at = np.concatenate([[0], np.cumsum(n_kept)]).tolist()
            texts = [b" ".join(kept_words[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("no_id"), pa.array(size.astype(np.int64)), pa.array((size - n_kept).astype(np.int64)), pa.array(texts, pa.binary()).cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                ["id", "no_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    met = rows.join(gone, F.col("id") == F.col("asked_id"), "left").select("id", "no_id", "text", "asked")
    out = met.mapInArrow(run, "id long, no_id boolean, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id").withColumnRenamed("id", id_col)


def dedup_all(documents: DataFrame, batches: int = BATCHES, width: int = WIDTH, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup of all documents, as `batches` batches by ranges of ids. The index goes at the end."""
    spark = documents.sparkSession
    if buckets is None:
        text_bytes = documents.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        buckets = max(6, -(-text_bytes // BUCKET_BYTES))
    index = FingerprintIndex(spark, scratch(spark, "index"), width, gram, fanout, buckets)
    at = F.col(id_col).cast("long")
    cuts = sorted(set(documents.select(at.alias("id")).approxQuantile("id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    cuts = [int(c) for c in cuts]
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = (F.lit(True) if low is None else F.coalesce(at > low, F.lit(True))) & (F.lit(True) if high is None else F.coalesce(at <= high, F.lit(False)))
        found = kept(dedup(documents.where(own), index, id_col, text_col).drop("kept"), "deduplicated")
        index.settle()
        out = found if out is None else out.unionByName(found)
    drop_path(spark, index.path)
    return out


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_all(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
stay AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN stay USING (doc_id)
"""
