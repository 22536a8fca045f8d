"""From the algebra to DataFrames.

A Relation is a DataFrame with a column of lexical forms for each attribute, and each attribute's kind. Branches
of a union that extend the same source are one scan. Of a table, the rows of all branches are an array that is
exploded. Of documents (JSON, XML), where a reference has many values, the branches' combinations of values are
exploded with the branch's number, and terms are made by number after that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.functions.registry import BUILTINS, FUNCTIONS, PLAIN_ARGUMENTS, FunctionRegistry
from kgspark.functions.terms import Val
from kgspark.plans.algebra import QUAD, Constant, EquiJoin, Expression, Extend, FunctionCall, Operator, Project, Reference, Source, Union


@dataclass
class Relation:
    df: DataFrame
    values: dict[str, Val]
    #: Of a union: the quads' text by part, which takes no terms in between.
    parts: Callable[[], list[DataFrame]] | None = None
    #: Whether no row can be of a named graph.
    default_only: bool = False

    def materialised(self, structs: bool = False) -> Relation:
        """Attributes as columns of their own."""
        columns, values, plain = [], {}, lambda name: F.col(f"`{name}`")
        for name, v in self.values.items():
            if structs or v.kind == "term":
                columns.append(T.as_struct(v).alias(name))
                values[name] = Val(plain(name), "term")
                continue
            columns.append(v.lex.alias(name))
            parts = {}
            for part, c in (("datatype", v.datatype), ("lang", v.lang)):
                parts[part] = c
                if isinstance(c, Column):
                    columns.append(c.alias(f"{name}|{part}"))
                    parts[part] = plain(f"{name}|{part}")
            if v.native is not None:
                columns.append(v.native.alias(f"{name}|native"))
                parts["native"] = plain(f"{name}|native")
            values[name] = Val(plain(name), v.kind, **parts, shape=v.shape, clean=v.clean)
        return Relation(self.df.select(*columns), values)

    def terms(self) -> DataFrame:
        """A TERM column for each attribute."""
        return self.materialised(structs=True).df

    def text(self, keep: list[str] | None = None) -> DataFrame:
        """subject, predicate, object, graph as N-Triples text, and the columns to keep; rows that are no triple are dropped."""
        if self.parts is not None and not keep:
            return reduce(DataFrame.unionByName, self.parts())
        s, p, o = (T.term_text(self.values[a], a) for a in ("subject", "predicate", "object"))
        g = self.values.get("graph")
        graph = F.lit(None).cast("string") if g is None else T.term_text(g, "graph")
        default = f"<{T.RR}defaultGraph>"
        rows = self.df.select(s.alias("subject"), p.alias("predicate"), o.alias("object"), F.when(graph != default, graph).alias("graph"), *(keep or []))
        return rows.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")


def compile_expression(e: Expression, values: dict[str, Val]) -> Val:
    if isinstance(e, Constant):
        return T.constant(e.value)
    if isinstance(e, Reference):
        return values.get(e.name) or T.null_val()
    if isinstance(e, FunctionCall):
        name = e.function.rpartition("#")[2]
        if name in PLAIN_ARGUMENTS and FunctionRegistry.get(e.function) == FunctionRegistry.get(FUNCTIONS + name):
            plain = [getattr(a.value, "value", a.value) if isinstance(a, Constant) else a for a in e.args[1:]]
            if any(isinstance(a, Expression) for a in plain):
                raise ValueError(f"{name}: arguments from the second on are constants")
            return BUILTINS[name](compile_expression(e.args[0], values), *plain)
        return FunctionRegistry.call(e.function, [compile_expression(a, values) for a in e.args])
    raise TypeError(f"no expression: {e!r}")


def lower(op: Operator, spark: SparkSession, strict: bool = False) -> Relation:
    out = _lower(op, spark, strict)
    out.default_only = _default_only(op)
    return out


def _default_only(op: Operator) -> bool:
    if isinstance(op, Union):
        return all(map(_default_only, op.parts))
    if isinstance(op, Project):
        return "graph" not in op.names or _default_only(op.parent)
    if isinstance(op, Extend):
        return isinstance(op.expression, Constant) and op.expression.value in (None, T.IRI(T.RR + "defaultGraph")) if op.attribute == "graph" else _default_only(op.parent)
    return "graph" not in op.attributes()


def _lower(op: Operator, spark: SparkSession, strict: bool) -> Relation:
    if isinstance(op, Source):
        return Relation(*op.reader.read(spark, op.iterator, dict(op.mappings), strict))
    if isinstance(op, Extend):
        parent = lower(op.parent, spark, strict)
        return Relation(parent.df, parent.values | {op.attribute: compile_expression(op.expression, parent.values)})
    if isinstance(op, Project):
        parent = lower(op.parent, spark, strict)
        return Relation(parent.df, {n: parent.values[n] for n in op.names})
    if isinstance(op, EquiJoin):
        return _join(op, spark, strict)
    if isinstance(op, Union):
        return _union(op, spark, strict)
    raise TypeError(f"no operator: {type(op).__name__}")


def _join(op: EquiJoin, spark: SparkSession, strict: bool) -> Relation:
    left, right = lower(op.left, spark, strict).materialised(), lower(op.right, spark, strict).materialised()
    shared = set(left.values) & set(right.values)
    dropped = [c for c in right.df.columns if c.split("|")[0] in shared]
    # Keys by names of their own, so that equal names on both sides can't meet.
    pairs = [(left.values[a], right.values[b]) for a, b in op.conditions()]
    # Whole numbers on both sides are compared as such, all else by its text, in which epsilon meets epsilon.
    whole = [a.native is not None and b.native is not None for a, b in pairs]
    key = lambda v, i: v.native if whole[i] else T.to_lexical(v)
    l_df = left.df.withColumns({f"l|{i}": key(a, i) for i, (a, _) in enumerate(pairs)})
    r_df = right.df.withColumns({f"r|{i}": key(b, i) for i, (_, b) in enumerate(pairs)}).drop(*dropped)
    if not op.left_attributes:
        df = l_df.crossJoin(r_df)
    else:
        on = None
        for i in range(len(op.left_attributes)):
            a, b = F.col(f"`l|{i}`"), F.col(f"`r|{i}`")
            one = a == b if whole[i] else a.eqNullSafe(b)
            on = one if on is None else on & one
        df = l_df.join(r_df, on, "inner")
    df = df.drop(*(f"{s}|{i}" for s in "lr" for i in range(len(op.left_attributes))))
    return Relation(df, right.values | left.values)


def _chain(op: Operator) -> tuple[Source, list[Operator]] | None:
    """The source of a branch that only extends and projects, and what is done to it, the first step first."""
    steps: list[Operator] = []
    while isinstance(op, (Extend, Project)):
        steps.append(op)
        op = op.parent
    return (op, steps[::-1]) if isinstance(op, Source) else None


def _union(op: Union, spark: SparkSession, strict: bool) -> Relation:
    names = op.attributes()
    groups: dict = {}
    for i, part in enumerate(op.parts):
        chain = _chain(part)
        shared = chain is not None and (chain[0].reader.single_valued or hasattr(chain[0].reader, "arrays") and not strict)
        groups.setdefault((chain[0].reader, chain[0].iterator) if shared else i, []).append((part, chain))
    frames = []
    for members in groups.values():
        if len(members) == 1:
            own = lower(members[0][0], spark, strict)
            own = Relation(own.df, {n: own.values.get(n, T.null_val()) for n in names})
            frames.append(own.terms())
        else:
            frames.append(_fused([c for _, c in members], names, spark, strict))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    if op.distinct:
        df = df.distinct()
    values = {n: Val(F.col(f"`{n}`"), "term") for n in names}
    if op.distinct or not {"subject", "predicate", "object"} <= set(names):
        return Relation(df, values)

    def parts() -> list[DataFrame]:
        return [lower(m[0][0], spark, strict).text() if len(m) == 1 else _fused([c for _, c in m], list(QUAD), spark, strict, text=True) for m in groups.values()]

    return Relation(df, values, parts)


def _fused(chains: list, names: list[str], spark: SparkSession, strict: bool, carry: list[str] | None = None, text: bool = False) -> DataFrame:
    if chains[0][0].reader.single_valued:
        return _fused_rows(chains, names, spark, strict, carry, text)
    return _fused_documents(chains, names, spark, text)


def _applied(steps: list[Operator], at: dict[str, Val], names: list[str], text: bool) -> dict[str, Column]:
    """The named attributes after a branch's steps: as text of quads, or as structs."""
    for step in steps:
        at = at | {step.attribute: compile_expression(step.expression, at)} if isinstance(step, Extend) else {n: at[n] for n in step.names}
    have = {n: at.get(n, T.null_val()) for n in names}
    if not text:
        return {n: T.as_struct(v).cast(T.TERM) for n, v in have.items()}
    made = {n: T.term_text(v, n) for n, v in have.items()}
    if have["graph"].shape == T.RR + "defaultGraph":
        made["graph"] = F.lit(None).cast("string")
    elif have["graph"].shape is None:
        made["graph"] = T.let(made["graph"], lambda g: F.when(g != f"<{T.RR}defaultGraph>", g))
    return made


def _same(name: str, branch: int, mappings: dict[str, str], steps: list[Operator]):
    """What an attribute of a branch is made of; the branch's number if it is more than an expression of queries."""
    made = {s.attribute: s.expression for s in steps if isinstance(s, Extend)}
    e = made.get(name)
    if e is None or e.references() & set(made) or not e.references() <= set(mappings):
        return branch
    return e, tuple(sorted((a, mappings[a]) for a in e.references()))


def _fused_documents(chains: list[tuple[Source, list[Operator]]], names: list[str], spark: SparkSession, text: bool) -> DataFrame:
    """One scan for several branches of documents."""
    source = chains[0][0]
    mappings = {q: f"q{i}" for i, q in enumerate(dict.fromkeys(q for s, _ in chains for _, q in s.mappings))}
    df = source.reader.arrays(spark, source.iterator, {a: q for q, a in mappings.items()})

    def combined(branch: int, left: list[str], bound: dict[str, Column]) -> Column:
        """An array of the branch's combinations of values; a struct if none is left to combine."""
        if not left:
            none = F.lit(None).cast("string")
            return F.struct(F.lit(branch).alias("branch"), *(bound.get(a, none).alias(a) for a in mappings.values()))
        inner = F.transform(F.col(left[0]), lambda x: combined(branch, left[1:], bound | {left[0]: x}))
        return inner if len(left) == 1 else F.flatten(inner)

    arrays = []
    for i, (own, _) in enumerate(chains):
        used = list(dict.fromkeys(mappings[q] for _, q in own.mappings))
        arrays.append(combined(i, used, {}) if used else F.array(combined(i, [], {})))
    df = df.select(F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("row"))
    made = [_applied(steps, {a: Val(F.col("row")[mappings[q]]) for a, q in own.mappings}, names, text) for own, steps in chains]
    out = []
    for n in names:
        # Branches with the same expression of the same queries share a case.
        cases: dict = {}
        for i, (own, steps) in enumerate(chains):
            cases.setdefault(_same(n, i, dict(own.mappings), steps), (made[i][n], []))[1].append(i)
        if len(cases) == 1:
            out.append(made[0][n].alias(n))
            continue
        value = F.lit(None).cast("string" if text else T.TERM)
        for c, branches in cases.values():
            value = F.when(F.col("row.branch").isin(*branches), c).otherwise(value)
        out.append(value.alias(n))
    df = df.select(*out)
    return df.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL") if text else df


def _chosen(row: Column, there: Column) -> Column:
    return F.get(F.filter(F.array(row), lambda _: there), F.lit(0))


def _fused_rows(chains: list[tuple[Source, list[Operator]]], names: list[str], spark: SparkSession, strict: bool, carry: list[str] | None = None, text: bool = False) -> DataFrame:
    """One scan for several branches of a source. A branch has a row where all attributes of its own source have a value. text: of quads, as text."""
    source = chains[0][0]
    mappings = {q: f"q{i}" for i, q in enumerate(dict.fromkeys(q for s, _ in chains for _, q in s.mappings))}
    df, values = source.reader.read(spark, source.iterator, {a: q for q, a in mappings.items()}, strict, keep_missing=True)
    branches = [({a: values[mappings[q]] for a, q in own.mappings}, steps, dict(own.mappings)) for own, steps in chains]
    made = [_applied(steps, at, names, text) for at, steps, _ in branches]
    # What all branches make of the same queries, as the subject mostly is, is made once for a row, before it is multiplied.
    common = [n for n in names if len({_same(n, i, queries, steps) for i, (_, steps, queries) in enumerate(branches)}) == 1] if len(chains) > 1 else []
    df = df.select("*", *(made[0][n].alias(f"__common_{n}") for n in common))
    needed = [n for n in ("subject", "predicate", "object") if text]
    whole = reduce(and_, (F.col(f"__common_{n}").isNotNull() for n in common if n in needed), F.lit(True))
    rows = []
    for (at, _, queries), columns in zip(branches, made, strict=True):
        there = reduce(and_, (source.reader.present(at[a]) for a in queries), whole)
        row = F.struct(*([c.alias(n) for n, c in columns.items() if n not in common] or [F.lit(0).alias("nothing")]))
        rows.append(F.when(there, row))
        if len(rows) == 1 and len(chains) > 1:
            # NULL, too, but with a higher-order function, which keeps the projection out of whole-stage code: there all rows
            # would be one method, beyond the 8000 bytes that the JVM compiles; here they are split.
            rows[0] = rows[0].otherwise(_chosen(row, there))
    kept = [F.col(f"__common_{n}") for n in common]
    # The array is a column of its own below the explode, so that generated code comes in smaller methods.
    df = df.select(F.array(*rows).alias("__rows"), *kept, *(carry or []))
    out = df.select(F.explode("__rows").alias("row"), *kept, *(carry or [])).where("row IS NOT NULL")
    for n in needed:
        out = out if n in common else out.where(F.col("row")[n].isNotNull())
    return out.select(*((F.col(f"__common_{n}") if n in common else F.col("row")[n]).alias(n) for n in names), *(carry or []))
