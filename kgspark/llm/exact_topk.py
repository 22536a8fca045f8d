"""Exact top-k by inner product: a KD-tree per shard.

Equal vectors are one vector with its smallest ids: those that can be among any query's k best. Queries of equal vectors are searched
for once, with one id more than k, and each asking id leaves itself out at the end. So copies cost a row each, and no search.

Vectors are dealt to shards by a hash, so results are the same however they are dealt; a shard holds about SHARD vectors (or CELLS
numbers) and is packed into one row, as are blocks of BLOCK queries. Up to GROUP shards are one task's: it builds their trees, and
then all blocks pass it, one row at a time, so that a block is sent once a group, and neither a task nor the driver holds more when tables grow.
In a tree, the widest dimension is split at the median, and each node keeps its tight bounding box and smallest id.
The box-to-query bound is the largest inner product that the box permits. Each query of a block reads the leaf of its best bound;
then nodes are visited best first, each by those queries alone whose k-th score (or, at equal scores, id) its bound beats,
until no bound beats any. A leaf's inner products with these queries are one product of matrices. The k-th score is propagated to the
group's next trees. Each group's winners are merged at the end.

Components become floor(scale * x). Integers are summed exactly: in floats while no sum can reach 2**24, in doubles while none can reach 2**53, else
in Python's integers (a score beyond a long's range is then clipped).

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids. Vectors
of different length are not compared. A query's own row is any of its id. Of queries with equal id the smallest
vector asks; candidates of equal id are candidates each. Fewer candidates than k: as many rows. Empty table: no rows. Very long vectors are packed whole.
Other columns are not read, so their names may clash. The work without copies is that of queries times vectors, save what the boxes spare.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._spark import dropped, kept, setting, table

K, SCALE, SHARD, BLOCK, LEAF, GROUP, CELLS, SPREAD, BATCH_ROWS = 5, 256, 4096, 2048, 128, 64, 1 << 18, 4, "16"


@dataclass
class Tree:
    """Nodes in order of creation; a leaf has rows[begin:end] of the reordered vectors. A vector's ids are ids[first[row]:first[row + 1]], in order."""

    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    children: list[tuple[int, int] | None]
    span: list[tuple[int, int]]
    vectors: np.ndarray
    ids: np.ndarray
    first: np.ndarray


def build(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF, first: np.ndarray | None = None) -> Tree:
    """first: where each vector's ids begin, and their number at the end; without it, each has one."""
    first = np.arange(len(vectors) + 1) if first is None else first
    order, smallest = np.arange(len(vectors)), ids[first[:-1]]
    low, high, least, children, span = [], [], [], [], []

    def node(begin: int, end: int) -> int:
        own = vectors[order[begin:end]]
        at = len(low)
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        least.append(int(smallest[order[begin:end]].min()))
        children.append(None)
        span.append((begin, end))
        wide = high[at] - low[at]
        d = int(wide.argmax())
        if end - begin > leaf and wide[d] > 0:
            half = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(own[:, d], half, kind="introselect") if own.dtype != object else np.argsort(own[:, d], kind="stable")]
            children[at] = (node(begin, begin + half), node(begin + half, end))
        return at

    node(0, len(vectors))
    size = np.diff(first)[order]
    moved = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1][order] - moved[:-1], size) + np.arange(moved[-1])
    return Tree(np.array(low), np.array(high), np.array(least, np.int64), children, span, vectors[order], ids[at], moved)


def _add(mine: list[tuple[int, int]], new: tuple[int, int], k: int) -> bool:
    """Adds (-score, id) to the list of a query that any id may ask: in order, as many as leave k without any one id. Gives whether the list is full."""
    bisect.insort(mine, new)
    same = [i for i, x in enumerate(mine) if x[1] == new[1]] if len(mine) > k else ()
    if len(same) > k:
        del mine[same[-1]]
    while len(mine) > k + 1 and len({x[1] for x in mine[:-1]}) > k:
        mine.pop()
    return len(mine) > k and len({x[1] for x in mine}) > k


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray | None, best: list[list[tuple[int, int]]], k: int = K) -> int:
    """Adds the tree's best to best: for each query at most k of (-score, id) in order; without query_ids, so many that k are left without any one id. Gives the number of leaves read."""
    n, zero, exact = len(queries), queries * 0, queries.dtype == object
    bounds = np.maximum(queries, zero) @ tree.high.T + np.minimum(queries, zero) @ tree.low.T
    # The k-th score and id of each query.
    full = [len(mine) == k if query_ids is not None else len({x[1] for x in mine}) > k for mine in best]
    kth = np.array([-mine[-1][0] if f else float("-inf") for mine, f in zip(best, full, strict=True)], queries.dtype)
    kth_id = np.array([mine[-1][1] if f else 0 for mine, f in zip(best, full, strict=True)], np.int64)
    done, leaves = np.full(n, -1), 0

    def read(at: int, of: np.ndarray) -> None:
        nonlocal leaves
        leaves += 1
        begin, end = tree.span[at]
        scores = (queries if len(of) == n else queries[of]) @ tree.vectors[begin:end].T
        floor = kth[of]
        if not exact and end - begin > k + 1 and (floor == -np.inf).any():
            # At least k vectors here have an id that is not the query's own, or k + 1 any id: of such, worse ones cannot be among its best.
            fresh = np.flatnonzero(floor == -np.inf)
            some = scores[fresh]
            if query_ids is not None:
                one = [(tree.ids[x] == query_ids[of[fresh]][:, None]) for x in (tree.first[begin:end], tree.first[begin + 1 : end + 1] - 1)]
                some = np.where(one[0] & one[1], -np.inf, some)  # all their ids, in order, are the query's
            elif len(np.unique(tree.ids[tree.first[begin:end]])) < end - begin:
                some = np.full_like(some, -np.inf)  # vectors of equal id are not as many ids
            floor[fresh] = np.partition(some, -(k + 1), axis=1)[:, -(k + 1)] if query_ids is None else np.partition(some, -k, axis=1)[:, -k]
        q_at, row = np.divmod(np.flatnonzero(scores >= floor[:, None]), end - begin)
        for j, i, score in zip(of[q_at].tolist(), (row + begin).tolist(), scores[q_at, row].tolist(), strict=True):
            mine, me = best[j], None if query_ids is None else int(query_ids[j])
            for x in tree.ids[tree.first[i] : tree.first[i + 1]].tolist():
                new = (-int(score), x)
                if full[j] and new >= mine[-1]:
                    break
                if me is None:
                    full[j] = _add(mine, new, k)
                elif x != me:
                    bisect.insort(mine, new)
                    del mine[k:]
                    full[j] = len(mine) == k
            if full[j]:
                kth[j], kth_id[j] = -mine[-1][0], mine[-1][1]

    def open_(at: int, of: np.ndarray) -> np.ndarray:
        """Those queries that the node may have something for: others have no better bound, and those that tie no smaller id."""
        b = bounds[of, at]
        return of[((b > kth[of]) | ((b == kth[of]) & (tree.least[at] < kth_id[of]))).astype(bool) & (done[of] != at)]

    ends = np.array([i for i, c in enumerate(tree.children) if c is None])
    first = ends[np.argmax(bounds[:, ends], axis=1)]
    for at in np.unique(first).tolist():
        own = open_(at, np.flatnonzero(first == at))
        if len(own):
            read(at, own)
    done = first
    todo = [(0, 0, np.arange(n))]
    while todo:
        _, at, of = heapq.heappop(todo)
        of = open_(at, of)
        if not len(of):
            continue
        if tree.children[at] is None:
            read(at, of)
            continue
        for c in tree.children[at]:
            if len(left := open_(c, of)):
                heapq.heappush(todo, (-int(bounds[left, c].max()), c, left))
    return leaves


def _coded(rows: DataFrame, scale: int) -> DataFrame:
    """rows: id, raw, ask. id, dim, key (the components' bytes, in 2 or 8 each), ask, and for those that ask `place` (bytes in the vectors' order), of usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def binary(numbers: np.ndarray) -> pa.Array:
            width = numbers.shape[1] * numbers.itemsize
            return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer((np.arange(len(numbers) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])

        for b in batches:
            b = b.filter(pc.greater(pc.fill_null(pc.list_value_length(b.column("raw")), 0), 0))
            dims = pc.list_value_length(b.column("raw")).to_numpy()
            for dim in np.unique(dims).tolist():
                here, step = b.filter(pa.array(dims == dim)), max(1, (1 << 21) // dim)
                for at in range(0, here.num_rows, step):
                    part = here.slice(at, step)
                    x = part.column("raw").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null becomes NaN
                    good = np.isfinite(x).all(axis=1)
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(x[good] * scale)
                        v = np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.where(x <= -(2.0**63), np.iinfo(np.int64).min, x.astype(np.int64)))
                    ids, ask = (part.column(c).to_numpy(zero_copy_only=False)[good] for c in ("id", "ask"))
                    small = ((v >= -(1 << 15)) & (v < 1 << 15)).all(axis=1)
                    for kind, chosen in ((np.int16, small), (np.int64, ~small)):
                        if chosen.any():
                            own = v[chosen]
                            place = binary((own.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8"))
                            place = pc.if_else(pa.array(ask[chosen]), place, pa.scalar(None, pa.binary()))
                            yield pa.RecordBatch.from_arrays([pa.array(ids[chosen]), pa.array(np.full(len(own), dim, np.int32)), binary(own.astype(kind)), pa.array(ask[chosen]), place], ["id", "dim", "key", "ask", "place"])

    return rows.mapInArrow(run, "id long, dim int, key binary, ask boolean, place binary")


def _packed(df: DataFrame, by: list[str]) -> DataFrame:
    """df: by, key, ids. A row for each group of by: vectors, ids and where each vector's begin, as bytes. Groups have a bounded expected size, by a hash."""
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]

    def run(group: pa.Table) -> pa.Table:
        dim, keys = group.column("dim")[0].as_py(), group.column("key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        small = all(len(x) == 2 * dim for x in keys)
        data = b"".join(keys[i] if small or len(keys[i]) == 8 * dim else np.frombuffer(keys[i], np.int16).astype(np.int64).tobytes() for i in order)
        ids = group.column("ids").combine_chunks().take(pa.array(order))
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
        out = {c: pa.array([group.column(c)[0].as_py()], group.schema.field(c).type) for c in by}
        return pa.table(out | {"ids": pa.array([ids.flatten().to_numpy().astype(np.int64).tobytes()]), "first": pa.array([first.astype(np.int64).tobytes()]), "vectors": pa.array([data]), "small": pa.array([small])})

    return df.select(*by, "key", "ids").groupBy(*by).applyInArrow(run, ", ".join(kinds) + ", ids binary, first binary, vectors binary, small boolean")


def _winners(rows: DataFrame, k: int) -> DataFrame:
    """rows, in order of cell: packed shards (block null) and then blocks. dim, lead, found, score: each cell's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, shards, trees = None, [], {}
        for r in (r for b in batches for r in b.to_pylist()):
            if cell != (r["dim"], r["cell"]):
                cell, shards, trees = (r["dim"], r["cell"]), [], {}
            dim = r["dim"]
            data = np.frombuffer(r["vectors"], np.int16 if r["small"] else np.int64).reshape(-1, dim)
            ids, top = np.frombuffer(r["ids"], np.int64), max(1, abs(int(data.max())), abs(int(data.min())))
            if r["block"] is None:
                shards.append((data, ids, np.frombuffer(r["first"], np.int64), top))
                continue
            best: list[list[tuple[int, int]]] = [[] for _ in ids]
            for i, (vectors, own, first, most) in enumerate(shards):
                kind = np.float32 if most * top * dim < 1 << 24 else np.float64 if most * top * dim < 1 << 52 else object
                if (i, kind) not in trees:
                    trees[i, kind] = build(vectors.astype(kind), own, first=first)
                search(trees[i, kind], data.astype(kind), None, best, k)
            size = [len(x) for x in best]
            flat = [x for mine in best for x in mine]
            score = [max(-(1 << 63), min((1 << 63) - 1, -x[0])) for x in flat]
            columns = [np.full(len(flat), dim, np.int32), np.repeat(ids, size), np.array([x[1] for x in flat], np.int64), np.array(score, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "lead", "found", "score"])

    return rows.mapInArrow(run, "dim int, lead long, found long, score long")


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, <id_col>, score. asks: which rows are queries, as a condition on the column `id`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw")).where("id IS NOT NULL")
    coded = kept(_coded(rows.withColumn("ask", F.coalesce(asks, F.lit(False))), scale), "coded")
    # Of each vector the k + 1 smallest ids: without any one, k are left. Of equal rows k.
    least = F.dense_rank().over(Window.partitionBy("dim", "key").orderBy("id"))
    some = coded.select("dim", "key", "id", least.alias("nth")).where(F.col("nth") <= k + 1).groupBy("dim", "key", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "n"))), lambda x: F.array_repeat(x["id"], x["n"])))
    every = kept(some.groupBy("dim", "key").agg(ids.alias("ids")), "vectors")
    asked = coded.where("ask").groupBy("id", "dim").agg(F.min_by("key", "place").alias("key"))
    asked = kept(asked.withColumn("lead", F.min("id").over(Window.partitionBy("dim", "key"))), "asked")  # one of equal queries leads
    dropped(coded)
    leads = asked.where("id = lead").select("dim", "key", F.array("lead").alias("ids"))

    def shares(df: DataFrame, most: int, name: str) -> DataFrame:
        each = F.least(F.lit(most), F.greatest(F.lit(16), F.floor(F.lit(CELLS) / F.col("dim"))))
        return df.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / each).cast("int").alias(name))

    # Lengths of more than one shard or block; there is no more than one for each of them.
    tasks = SPREAD * spark.sparkContext.defaultParallelism
    cells = F.least("shards", F.greatest(F.lit(tasks), F.ceil(F.col("shards") / group))).cast("int").alias("cells")
    sizes = shares(every, shard, "shards").join(shares(leads, block, "blocks"), "dim").where("shards > 1 OR blocks > 1").select("dim", "shards", "blocks", cells)
    sizes = F.broadcast(kept(sizes, "sizes"))
    n_parts = max(tasks, sizes.agg(F.sum("cells")).first()[0] or 0)
    one = lambda c: F.coalesce(c, F.lit(1))
    dealt = lambda df, salt, c, name: df.join(sizes, "dim", "left").withColumn(name, F.pmod(F.xxhash64(F.lit(salt), "key"), one(c)).cast("int"))
    shards = _packed(dealt(every, 0, "shards", "shard").withColumn("cell", F.col("shard") % one("cells")), ["dim", "shard", "cell"]).withColumn("block", F.lit(None).cast("int"))
    blocks = _packed(dealt(leads, 1, "blocks", "block"), ["dim", "block"]).join(sizes.select("dim", "cells"), "dim", "left")
    blocks = blocks.withColumn("shard", F.lit(None).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), one("cells") - 1))).drop("cells")
    met = shards.unionByName(blocks).repartitionById(n_parts, F.pmod(F.hash("dim") + F.col("cell"), F.lit(n_parts))).sortWithinPartitions("dim", "cell", F.col("block").asc_nulls_first(), "shard")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS):  # shards and blocks wait in a batch
        won = kept(_winners(met, k), "winners")
    # Of equal ids k, and of all 2 k: without any one id, k are left.
    order = [F.desc("score"), "found"]
    won = won.repartition("dim", "lead").withColumn("nth", F.row_number().over(Window.partitionBy("dim", "lead", "found").orderBy(F.desc("score")))).where(F.col("nth") <= k)
    won = won.withColumn("nth", F.row_number().over(Window.partitionBy("dim", "lead").orderBy(*order))).where(F.col("nth") <= 2 * k).drop("nth")
    out = asked.select("dim", "lead", F.col("id").alias("query_id")).join(won, ["dim", "lead"]).where("found <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return out.select("query_id", rank.alias("rank"), F.col("found").alias(id_col), "score").where(F.col("rank") <= k)


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
