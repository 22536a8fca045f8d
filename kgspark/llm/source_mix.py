"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1.  Targets. Sources in order of code points (null last) weigh `weights` in turn and share `share` times all
    words; none may exceed `most` times its own words, and what is over goes to the others by weight. The
    fixed point is min(cap, weight * level); `level` comes from sorted ratios cap / weight.
2.  Blocks. A document's place in its source's permutation is a hash of its id and text. The first CELL_BITS bits of
    that place are its cell; a block is a cell in one pass over the source. A target of q whole passes and a
    rest takes all cells q times, and once more the cells in order until the rest is filled: down to one
    document, of which the missing words are taken. A source's words hence equal its rounded target.
3.  Splitting tree. The blocks of each source are exact quotas at the root. Each node halves its number of
    blocks; how many of each source go left is a draw from the multivariate hypergeometric distribution, one
    source after another, by inversion with a seeded hash as the random number. The leaves are output shards.
4.  A source's blocks in permuted order go to the shards by their quotas: what no shard draws is not taken. mixed() has each
    document once for each block of it that a shard draws, with the words that it takes, and shuffles each shard by a hash. A document's `taken` is
    the sum of these.

Only tables of sources x cells are windowed, never all documents of a source. Tables of sources and blocks are broadcast if they have no more than
MOST_ROWS rows (of a hundred bytes); else they are joined by shuffle. The tree's nodes hold all sources' quotas, so sources must be few: some thousands.

Null text: size 0. Null source: a source of its own, the last. Sizes of 0 take nothing. Null and repeated ids
are permitted: rows are carried along, and equal rows share a place. Ties in the order of places go by id, then size. Equal input gives equal output. Empty table: no rows.
Long texts: their words are counted, whole, and nothing grows with them. Names of other columns may clash; they are kept in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._spark import kept, table

WEIGHTS, SHARE, MOST, SHARD_BITS, SEED = (5, 2, 1), 1.5, 2, 4, 17
CELL_BITS, MOST_ROWS = 8, 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds idx (from 0), weight and target."""
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cap = F.col("source_size") * F.lit(most)
    by_ratio = Window.orderBy("ratio", "idx")
    return (
        sizes.withColumn("idx", turn)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("idx") % len(weights) + 1))
        .withColumn("all_words", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", (F.col("all_words") - F.sum(cap).over(by_ratio) + cap) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.min_by("level", F.when(~F.col("full"), F.struct("ratio", "idx"))).over(Window.partitionBy()))
        .select("source", "source_size", "idx", "weight", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def _first_over(cells: DataFrame, by: str) -> DataFrame:
    """Of rows source, <by>, words, rest: the row at which the running sum reaches rest, with the words before it."""
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))


def _draw(total: str, mine: str, left: str, chance: str) -> str:
    """SQL: of `total` things `mine` are of a kind and `left` are drawn; how many of the kind are drawn, where `chance` is uniform in [0, 1)."""
    low, high = f"greatest(0L, {left} - ({total} - {mine}))", f"least({left}, {mine})"
    step = f"ln(cast({mine} - k + 1 as double) * ({left} - k + 1)) - ln(cast(k as double) * ({total} - {mine} - {left} + k))"
    logs = f"if({high} = {low}, array(0D), aggregate(sequence({low} + 1, {high}), array(0D), (a, k) -> concat(a, array(element_at(a, -1) + {step}))))"
    parts = f"transform(array({logs}), l -> transform(array(array_max(l)), m -> transform(l, v -> exp(v - m)))[0])[0]"
    return f"{low} + transform(array({parts}), w -> aggregate(w, named_struct('sum', 0D, 'n', 0L), (a, v) -> named_struct('sum', a.sum + v, 'n', if((a.sum + v) <= {chance} * aggregate(w, 0D, (b, y) -> b + y), a.n + 1L, a.n)), a -> least(a.n, size(w) - 1L)))[0]"


def splitting_tree(quotas: DataFrame, bits: int = SHARD_BITS, seed: int = SEED) -> DataFrame:
    """quotas: idx int, quota long (few rows). Gives shard, idx, quota: each source's quotas add up, and shards differ by a block at most."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("quota").cast("long").alias("quota")))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    drawn = _draw("acc.rest", "x.quota", "acc.to_left", f"(pmod(xxhash64(acc.seed, x.idx), 4503599627370496) / 4503599627370496D)")
    for level in range(bits):
        total = "aggregate(q, 0L, (a, x) -> a + x.quota)"
        take = f"transform(array({drawn}), d -> named_struct('rest', acc.rest - x.quota, 'to_left', acc.to_left - d, 'seed', acc.seed, 'out', concat(acc.out, array(d))))[0]"
        start = f"named_struct('rest', total, 'to_left', (total + pmod(xxhash64({seed}, node), 2)) div 2, 'seed', xxhash64({seed}, {level}, node), 'out', cast(array() as array<bigint>))"
        nodes = (
            nodes.withColumn("total", F.expr(total))
            .withColumn("left", F.expr(f"aggregate(q, {start}, (acc, x) -> {take}, acc -> acc.out)"))
            .select(
                F.explode(
                    F.array(
                        F.struct((F.col("node") * 2).alias("node"), F.expr("transform(q, (x, i) -> named_struct('idx', x.idx, 'quota', left[i]))").alias("q")),
                        F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("transform(q, (x, i) -> named_struct('idx', x.idx, 'quota', x.quota - left[i]))").alias("q")),
                    )
                ).alias("child")
            )
            .select("child.*")
        )
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode("q").alias("x")).select("shard", "x.idx", "x.quota")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, shard_bits: int = SHARD_BITS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """row (a number of its own), id_col, source, size, source_size, target, draws (array of shard, nth, words: the blocks that take the row) of each row; with keep, a struct `kept` of these columns."""
    # One expression for each bit field of the permutation: cell, finer cell, the rest.
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    bits = lambda skip: F.shiftrightunsigned("place", 64 - skip - CELL_BITS).bitwiseAND((1 << CELL_BITS) - 1).cast("int")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    also = [] if keep is None else [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")]
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), place.alias("place"), *also)
    rows = kept(rows, "mix-sizes")
    rows = rows.withColumn("cell", bits(0)).withColumn("fine", bits(CELL_BITS))
    cells = kept(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    sources = kept(sources.withColumn("rest", goal - F.col("passes") * F.col("source_size")), "mix-sources")
    few = sources.count() <= MOST_ROWS  # as are the edges: one a source at most

    def with_sources(df: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
        other = other.withColumnRenamed("source", "other_source")
        return df.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("other_source")), how).drop("other_source")

    # The cell, the finer cell and the document at which the rest is filled.
    rest = sources.select("source", "rest").where("rest > 0")
    edge = _first_over(with_sources(cells, rest, "inner"), "cell").select("source", F.col("cell").alias("edge_cell"), (F.col("rest") - F.col("before")).alias("rest"))
    edge = kept(edge, "mix-edge")
    in_edge = with_sources(rows, edge, "inner").where("cell = edge_cell")
    fine = in_edge.groupBy("source", "fine", "edge_cell", "rest").agg(F.sum("size").alias("words"))
    fine = _first_over(fine, "fine").select("source", "edge_cell", F.col("fine").alias("edge_fine"), (F.col("rest") - F.col("before")).alias("edge_rest"))
    fine = kept(fine, "mix-fine")

    sized = with_sources(with_sources(rows, sources.drop("rest")), fine)
    at_edge = (F.col("cell") == F.col("edge_cell")) & (F.col("fine") == F.col("edge_fine"))
    below = (F.col("cell") < F.col("edge_cell")) | (F.col("cell") == F.col("edge_cell")) & (F.col("fine") < F.col("edge_fine"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    last = sized.where(at_edge).withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("edge_rest") - F.coalesce(before, F.lit(0)))))
    rest_of = sized.where(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", F.when(below, F.col("size")).otherwise(0))
    out = last.unionByName(rest_of)

    # Blocks, their quotas and their shards.
    blocks = with_sources(with_sources(cells.where("words > 0"), sources), edge.drop("rest"))
    times = F.col("passes") + F.when(F.col("cell") <= F.col("edge_cell"), 1).otherwise(0)
    blocks = blocks.where(times > 0).select("source", "idx", "cell", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("pass"))
    blocks = blocks.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed), "idx", "cell", "pass"), "cell", "pass")))
    to = Window.partitionBy("idx").orderBy("shard")
    leaves = splitting_tree(blocks.groupBy("idx").agg(F.count("*").alias("quota")), shard_bits, seed)
    leaves = leaves.withColumn("upto", F.sum("quota").over(to)).withColumn("above", F.col("upto") - F.col("quota")).where("quota > 0").withColumnRenamed("idx", "leaf_idx")
    leaves = leaves.select("leaf_idx", "shard", "above", "upto")
    placed = blocks.join(leaves, (F.col("idx") == F.col("leaf_idx")) & (F.col("rank") > F.col("above")) & (F.col("rank") <= F.col("upto")))
    placed = placed.groupBy("source", F.col("cell").alias("block_cell")).agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("placed")).withColumnRenamed("source", "block_source")
    placed = kept(placed, "mix-blocks")
    out = out.join(F.broadcast(placed) if placed.count() <= MOST_ROWS else placed, F.col("source").eqNullSafe(F.col("block_source")) & (F.col("cell") == F.col("block_cell")), "left")
    # What a drawn block has of the row: in whole passes all its words, in the last one those that fill the rest.
    words = lambda x: F.when(x["pass"] <= F.col("passes"), F.col("size")).otherwise(F.col("extra"))
    draws = F.filter(F.transform("placed", lambda x: F.struct(x["shard"].alias("shard"), x["pass"].alias("nth"), words(x).cast("long").alias("words"))), lambda x: x["words"] > 0)
    none = F.array().cast("array<struct<shard:int,nth:bigint,words:bigint>>")
    return out.select("row", F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce(draws, none).alias("draws"), *(["kept"] if keep is not None else []))


def mixed(plan: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The plan's rows once for each block that takes them, with shard, nth (the pass) and words (how many it takes) instead of draws; each shard in a shuffled order."""
    out = plan.select(*(c for c in plan.columns if c != "draws"), F.explode("draws").alias("draw")).select("*", "draw.*").drop("draw")
    order: Column = F.xxhash64(F.lit(seed + 1), F.col(id_col), "size", "nth")
    return out.repartition("shard", F.pmod(order, F.lit(64))).sortWithinPartitions("shard", order)


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    plan = kept(mix(table(spark, sf_dir, "documents")), "mix-plan")
    drawn = mixed(plan).groupBy(F.col("row").alias("drawn")).agg(F.sum("words").alias("taken"), F.array_join(F.sort_array(F.collect_list(F.struct("nth", F.col("shard").cast("string").alias("shard"))))["shard"], ",").alias("shards"))
    out = plan.join(drawn.hint("merge"), F.col("row") == F.col("drawn"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))
