"""Near copies by Jaccard similarity of word shingles: all pairs at or above a threshold, without sampling.

A text is the set of its SHINGLE-word shingles (lower-cased; a shorter text is one shingle); texts of equal sets are
one node, of which one text stands for all. Fingerprints of op5's kind, over these shingles, propose pairs that differ in 2 bits or fewer; but
similar sets may differ in 10 bits and more, so the rest comes from the sets themselves. Sets of similarity t or more share an
element among the first s - ceil(t * s) + 1 of each (s: its size), in any order that is the same for all sets. The
order is that of hashes, with common elements last: those that more than CROWD nodes have among their first are moved to
the end, in up to ROUNDS readings of the texts (at most LATE of them, the most common ones; the order decides on the work, never on the result).

Whatever the fingerprints or such an element proposes must pass two exact bounds first: sizes, and parities (the numbers of elements in
each of PARITY classes of hashes, modulo 2; sets differ in no fewer elements than classes). What passes is compared by whole sets:
1.  Each node with the smallest node of each of its elements. This settles the elements whose nodes it connects.
2.  Of other elements with up to CROWD nodes, all pairs that are not connected yet.
3.  Other elements' nodes, tied to crowds: each node outside its crowd's main component with all nodes of the crowd, in
    tiles of some BLOCK elements a side. A tile gives no more links than it connects.
Nodes with many partners are dealt to lanes, so no task holds a group's sets at once.

Tables that grow with the documents are joined by sort and merge. Null text and text without words: the empty set,
one node. Empty table: no rows. Sets and elements are known by 64-bit hashes. Rows of equal id, and of none, each get a row.
Very long texts are taken whole: memory follows the longest text. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._components import components
from kgspark.llm._spark import dropped, kept
from kgspark.llm._words import NOT_SPACE, U, _words, long_array, mix, pieces, prefix, spans, words
from kgspark.llm.simhash_dedup import fingerprints
from kgspark.llm.simhash_dedup import links as close_prints

SHINGLE, SIMILARITY, CROWD, ROUNDS, LATE, LANE, BLOCK = 5, Fraction(4, 5), 16, 2, 1 << 20, 256, 1 << 18
PARITY, LARGE = (1024, 16384), 2000  # classes of a set, and of one of more than LARGE elements


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its set: sorted elements of all, where each text's begin (and the end), and the set's hash."""
    w = words(texts, NOT_SPACE, True)
    n, size = len(w.first) - 1, np.diff(w.first)
    number = np.where(size >= shingle, size - shingle + 1, (size > 0).astype(size.dtype))
    total = np.concatenate([[0], np.cumsum(number)])
    at = np.repeat(w.first[:-1] - total[:-1], number) + np.arange(total[-1])
    end = np.minimum(at + shingle, np.repeat(w.first[1:], number))
    h = mix(spans(prefix(w.hashes(), _words), at, end, _words) + (end - at).astype(U))
    doc = np.repeat(np.arange(n), number)
    order = np.lexsort((h.view(np.int64), doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    begin = np.searchsorted(doc, np.arange(n + 1))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
    return h, begin, mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(U))


def _firsts(sizes: np.ndarray, similarity: Fraction) -> np.ndarray:
    """How many elements of a set of each size one of which any similar set shares."""
    least = -(-sizes * similarity.numerator // similarity.denominator)
    return np.where(sizes > 0, sizes - least + 1, 0)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), long_array(values))


def _similar(shared: np.ndarray, one: np.ndarray, two: np.ndarray, similarity: Fraction) -> np.ndarray:
    return shared * similarity.denominator >= (one + two - shared) * similarity.numerator


def _nodes(documents: DataFrame, shingle: int) -> DataFrame:
    """documents: id, own, text. id, own, node of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("own"), long_array(shingle_sets(b.column("text"), shingle)[2])], ["id", "own", "node"])

    kind = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(run, f"id {kind}, own long, node long")


def _firsts_of(texts: DataFrame, late: np.ndarray, shingle: int, similarity: Fraction) -> DataFrame:
    """texts: node, text. node, size (of its set), parity, elements (the first ones, late ones after all others)."""
    shared = texts.sparkSession.sparkContext.broadcast(late)  # LATE numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            h, begin, node = shingle_sets(b.column("text"), shingle)
            sizes = np.diff(begin)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            classes = np.where(sizes > LARGE, PARITY[1], PARITY[0])
            base = np.concatenate([[0], np.cumsum(classes)])
            odd = np.bincount(base[doc] + (mix(h) % classes[doc].astype(U)).astype(np.int64), minlength=int(base[-1])) & 1
            parity = np.packbits(odd.astype(np.uint8)).view(np.int64)
            if len(shared.value) and len(h):
                own = h.view(np.int64)
                moved = shared.value[np.minimum(np.searchsorted(shared.value, own), len(shared.value) - 1)] == own
                h = h[np.argsort(2 * doc + moved, kind="stable")]
            take = _firsts(sizes, similarity)
            rank = np.arange(len(h)) - np.repeat(begin[:-1], sizes)
            parities = _lists(parity, classes // 64)
            yield pa.RecordBatch.from_arrays([long_array(node), long_array(sizes), parities, _lists(h[rank < np.repeat(take, sizes)], take)], ["node", "size", "parity", "elements"])

    return texts.mapInArrow(run, "node long, size long, parity array<long>, elements array<long>")


def _possible(pairs: DataFrame, firsts: DataFrame, similarity: Fraction) -> DataFrame:
    """pairs: a, b. Those that sizes and parities permit."""
    one, two = (firsts.select(F.col("node").alias(f"{x}_node"), F.col("size").alias(f"{x}_size"), F.col("parity").alias(f"{x}_parity")) for x in "ab")
    met = pairs.join(one.hint("merge"), F.col("a") == F.col("a_node")).join(two.hint("merge"), F.col("b") == F.col("b_node"))
    differ = "if(size(a_parity) = size(b_parity), aggregate(zip_with(a_parity, b_parity, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y), 0)"
    # |x - y| + |y - x| = |x| + |y| - 2 |x & y|, and a similarity of t needs |x & y| >= t / (1 + t) * (|x| + |y|).
    t, of = similarity.numerator, similarity.denominator
    return met.where(f"least(a_size, b_size) * {of} >= greatest(a_size, b_size) * {t} and ({differ}) * {of + t} <= (a_size + b_size) * {of - t}").select("a", "b")


def _sets(texts: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """asked: node. node, elements (all of its set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            h, begin, node = shingle_sets(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([long_array(node), _lists(h, np.diff(begin))], ["node", "elements"])

    met = texts.join(asked.withColumnRenamed("node", "asked_node").hint("merge"), F.col("node") == F.col("asked_node"), "left_semi")
    return met.select("text").mapInArrow(run, "node long, elements array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """pairs: a, b. The similar ones. A node's partners are dealt to lanes of about LANE; its set goes to each lane once."""
    lanes = pairs.groupBy(F.col("a").alias("many")).agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    dealt = pairs.join(lanes.hint("merge"), F.col("a") == F.col("many")).select("a", F.pmod(F.xxhash64("b"), F.col("lanes")).cast("int").alias("lane"), "b")
    dealt = kept(dealt, "dealt")
    asked = dealt.select("a", "lane").distinct().select("a", "lane", F.lit(0).alias("side"), F.col("a").alias("of")).union(dealt.select("a", "lane", F.lit(1), "b"))
    rows = asked.join(sets.select("node", "elements").hint("merge"), F.col("of") == F.col("node")).drop("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, U)
        for b in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            column, side = b.column("elements"), b.column("side").to_numpy()
            flat = column.flatten().to_numpy().view(U)
            sizes = np.diff(column.offsets.to_numpy())
            turn = np.cumsum(side == 0)  # which asking set a row goes with; 0 is that of the batch before
            of = np.repeat(turn, sizes)
            asks = np.repeat(side == 0, sizes)
            # Elements of a turn, told apart from those of others.
            mine = np.sort(np.concatenate([held, flat[asks] ^ mix(of[asks].astype(U))]) if len(held) else flat[asks] ^ mix(of[asks].astype(U)))
            own = flat[~asks] ^ mix(of[~asks].astype(U))
            there = mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own if len(mine) else np.zeros(len(own), bool)
            shared = np.bincount(np.repeat(np.arange(len(side)), sizes)[~asks], there, len(side)).astype(np.int64)
            ask_size = np.append(len(held), sizes[side == 0])[turn]
            good = (side == 1) & _similar(shared, sizes, ask_size, similarity)
            if (side == 0).any():
                last = np.flatnonzero(side == 0)[-1]
                start = int(column.offsets[last].as_py() - column.offsets[0].as_py())
                held = flat[start : start + sizes[last]] ^ mix(np.zeros(1, U))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("of")], ["a", "b"]).filter(pa.array(good))

    # Lanes stay whole in a partition, in the order of sides.
    return rows.repartition("a", "lane").sortWithinPartitions("a", "lane", "side").select("a", "side", "of", "elements").mapInArrow(run, "a long, b long")


def connecting(asks: tuple, members: tuple, similarity: Fraction) -> tuple[list[int], list[int]]:
    """Each of asks and members: nodes, components, flat elements, sizes. Pairs of similar sets that connect all components that such pairs of an asking set and a member connect."""
    nodes, comp, flat, sizes = members
    known = np.unique(np.concatenate([asks[1], comp]))
    parent = np.arange(len(known))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, every = np.unique(np.concatenate([asks[2], flat]), return_inverse=True)
    asked, flat = every[: len(asks[2])], every[len(asks[2]) :]
    mark = np.zeros(len(every) + 1, bool)
    start, own = np.concatenate([[0], np.cumsum(asks[3])]), np.searchsorted(known, comp)
    row = np.repeat(np.arange(len(nodes)), sizes)
    one, two = [], []
    for i, at in enumerate(np.searchsorted(known, asks[1]).tolist()):
        mine = asked[start[i] : start[i + 1]]
        mark[mine] = True
        hit = np.flatnonzero(_similar(np.bincount(row, mark[flat], len(nodes)).astype(np.int64), sizes, len(mine), similarity))
        mark[mine] = False
        for j in hit.tolist():
            x, y = root(at), root(int(own[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                one.append(int(asks[0][i]))
                two.append(int(nodes[j]))
    return one, two


def _tiles(members: DataFrame, sets: DataFrame, similarity: Fraction, block: int) -> DataFrame:
    """members: crowd, node, comp, size. a, b: similar nodes that connect what similar nodes of a crowd connect beyond comp."""
    by_comp = members.groupBy("crowd", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    crowds = by_comp.groupBy(F.col("crowd").alias("own")).agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.max(F.struct("n", "comp", "size"))["size"].alias("settled"), F.sum("size").alias("size"))
    crowds = kept(crowds.select("own", "main", F.ceil(F.col("size") / block).cast("int").alias("across"), F.ceil((F.col("size") - F.col("settled")) / block).cast("int").alias("down")).where("down > 0"), "crowds")
    met = members.drop("size").join(crowds.hint("merge"), F.col("crowd") == F.col("own")).join(sets.withColumnRenamed("node", "s_node").hint("merge"), F.col("node") == F.col("s_node"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = met.where("comp != main").select("crowd", place("down").alias("i"), every("across").alias("j"), F.lit(0).alias("side"), "node", "comp", "elements")
    own = met.select("crowd", every("down").alias("i"), place("across").alias("j"), F.lit(1).alias("side"), "node", "comp", "elements")

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for side in (0, 1):
            t = group.filter(pa.array(group.column("side").to_numpy() == side)).combine_chunks()
            column = t.column("elements").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
            empty = not t.num_rows
            parts.append((t.column("node").to_numpy(), t.column("comp").to_numpy(), np.empty(0, np.int64) if empty else column.flatten().to_numpy(), np.empty(0, np.int64) if empty else np.diff(column.offsets.to_numpy())))
        a, b = connecting(*parts, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return asks.union(own).groupBy("crowd", "i", "j").applyInArrow(run, "a long, b long")


def proposed(texts: DataFrame, shingle: int) -> DataFrame:
    """texts: node, text. a, b: nodes whose fingerprints over these shingles op5 links, enough of them to connect all that it connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("node"), long_array(fingerprints(b.column("text"), shingle))], ["node", "print"])

    prints = kept(texts.mapInArrow(run, "node long, print long"), "prints")
    least = kept(prints.groupBy(F.col("print").alias("own")).agg(F.min("node").alias("least")), "least")
    same = prints.join(least.hint("merge"), F.col("print") == F.col("own")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    linked = close_prints(least.select(F.col("own").alias("print")))
    for end in ("a", "b"):
        linked = linked.join(least.select(F.col("own").alias("met"), F.col("least").alias(f"{end}_node")).hint("merge"), F.col(end) == F.col("met")).drop("met")
    return same.union(linked.select("a_node", "b_node")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(texts: DataFrame, shingle: int = SHINGLE, similarity: Fraction = SIMILARITY, crowd: int = CROWD, most_late: int = LATE, block: int = BLOCK) -> DataFrame:
    """texts: node, text. a, b: similar nodes that connect all that similar pairs connect."""
    late = np.empty(0, np.int64)
    for turn in range(ROUNDS + 1):
        firsts = kept(_firsts_of(texts, late, shingle, similarity), "firsts")
        rows = firsts.select("node", "size", F.explode("elements").alias("element"))
        counted = rows.groupBy(F.col("element").alias("met")).agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("least")).where("n > 1")
        counted = kept(counted.select("met", "n", F.col("least.node").alias("a"), F.col("least.size").alias("size_a")), "counted")
        many = counted.where(F.col("n") > crowd).orderBy(F.desc("n"), "met").limit(most_late).select("met").toArrow().column(0).to_numpy()  # numbers, most_late at most
        new = np.setdiff1d(many, late)[: most_late - len(late)]
        if turn == ROUNDS or not len(new):
            break
        late = np.union1d(late, new)
        dropped(firsts)
        dropped(counted)

    of = rows.join(counted.hint("merge"), F.col("element") == F.col("met"))
    star = of.where("node > a").where(F.least("size", "size_a") * similarity.denominator >= F.greatest("size", "size_a") * similarity.numerator).select("a", F.col("node").alias("b"))
    pairs = kept(_possible(kept(star.union(proposed(texts, shingle)).distinct(), "stars"), firsts, similarity), "pairs")
    sets = kept(_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle), "sets")
    near = kept(_compared(pairs, sets, similarity), "near")
    dropped(sets)

    comps = kept(components(near), "comps").withColumnRenamed("node", "c_node")
    left = of.where("n > 2").join(comps.hint("merge"), F.col("node") == F.col("c_node"), "left").select("met", "n", "node", "size", F.coalesce("root", "node").alias("comp"))
    left = kept(left, "members")
    unsettled = left.groupBy(F.col("met").alias("open")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("open")
    left = kept(left.join(kept(unsettled, "unsettled").hint("merge"), F.col("met") == F.col("open"), "left_semi"), "left")
    few = left.where(F.col("n") <= crowd).groupBy("met").agg(F.array_sort(F.collect_list(F.struct("node", "comp"))).alias("all"))  # crowd at most
    few = few.select(F.posexplode("all").alias("at", "x"), "all").select("x", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("y")).where("x.comp != y.comp")
    few = kept(_possible(few.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), firsts, similarity), "few")

    large = left.where(F.col("n") > crowd)
    tied = large.join(counted.select(F.col("met").alias("tie"), "a").hint("merge"), F.col("met") == F.col("tie")).where("node != a").select("a", F.col("node").alias("b"))
    roots = kept(components(tied), "crowd-roots").select(F.col("node").alias("r_node"), F.col("root").alias("crowd"))
    members = kept(large.select("node", "comp", "size").distinct().join(roots.hint("merge"), F.col("node") == F.col("r_node")).select("crowd", "node", "comp", "size"), "crowd-members")
    sets = kept(_sets(texts, few.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct(), shingle), "more-sets")
    near_few = kept(_compared(few, sets, similarity), "near-few")
    near_large = kept(_tiles(members, sets, similarity, block), "near-large")
    for df in (firsts, counted, pairs, sets, left, few):
        dropped(df)
    return near.union(near_few).union(near_large)


def near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY, crowd: int = CROWD, most_late: int = LATE, block: int = BLOCK) -> DataFrame:
    """id_col, own (a hash of id and text), group (a number for what pairs of similar texts connect), component (its smallest id) of each row."""
    text = F.col(text_col).cast("string")
    documents = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("own"), text.alias("text"))
    every = kept(_nodes(documents, shingle), "every")
    repeated = not every.groupBy("own").count().where("count > 1").isEmpty()
    nodes = kept(every.groupBy("node").agg(F.min("id").alias("first"), F.min("own").alias("rep")), "nodes")
    texts = documents.join(nodes.select("node", "rep").hint("merge"), F.col("own") == F.col("rep")).select("node", "text")
    texts = kept(texts.dropDuplicates(["node"]) if repeated else texts, "texts")
    found = kept(components(links(texts, shingle, similarity, crowd, most_late, block)), "roots")
    dropped(texts)
    rooted = nodes.join(found.withColumnRenamed("node", "f_node").hint("merge"), F.col("node") == F.col("f_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    heads = kept(rooted.groupBy("root").agg(F.min("first").alias("component")), "heads")
    labels = kept(rooted.join(heads.hint("merge"), "root").select(F.col("node").alias("own_node"), F.col("root").alias("group"), "component"), "labels")
    return every.join(labels.hint("merge"), F.col("node") == F.col("own_node")).select(F.col("id").alias(id_col), "own", "group", "component")
