"""Mappings over streams.

Source, Extend, Project and Union keep no state, so a mapping's plan runs on a streaming DataFrame as it is.
Duplicates are dropped within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.plans.mapping import Mapping, Options


def stream_quads(spark, mapping: str, streams: dict[str, DataFrame], watermark: tuple[str, str] | None = None) -> DataFrame:
    """A streaming DataFrame of quads. streams: by the names that the mapping's tables have. watermark: event time column of the streams and delay; with it each line is given once within the delay."""
    if watermark is None:
        return Mapping(mapping, options=Options(frames=streams)).execute(spark).text()
    column, delay = watermark
    if len(streams) != 1:
        raise ValueError("duplicates are dropped within the watermark of one stream")
    (name, df), = streams.items()
    marked = df.withWatermark(column, delay)
    out = Mapping(mapping, options=Options(frames={name: marked})).plan()
    from kgspark.operators.lower import Relation, _chain, _fused
    from kgspark.plans.algebra import QUAD, Union

    parts = out.parts if isinstance(out, Union) else (out,)
    chains = [_chain(p) for p in parts]
    if any(c is None for c in chains):
        raise ValueError("a join of streams needs bounds in time, which mappings do not have")
    rows = _fused(chains, [*QUAD], spark, False, carry=[column])
    from kgspark.functions.terms import Val

    text = Relation(rows, {n: Val(F.col(n), "term") for n in QUAD}).text(keep=[column])
    return text.dropDuplicatesWithinWatermark(["subject", "predicate", "object", "graph"])
