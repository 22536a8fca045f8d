"""JSON documents: a path iterates, paths extract; all in columns.

Nodes are JSON texts. A path is names, lists of names, indexes (negative ones from the end), slices [a:b:c], [*], .*,
'..' and filters [?(...)]. [*] and slices of what is no list take the thing itself (nothing, if it is empty). '..' goes
down as far as a document does. A filter keeps the children for which its condition holds: paths from @, comparisons
with constants or other paths (numbers with numbers, texts with texts), &&, || and !. Lists among the values of an
extraction are flattened one level. JSON null is epsilon (the row is there), a missing key and an empty list are no
value (the row isn't). Objects have no lexical form.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import Val, double_text
from kgspark.sources.base import Reader, explode_all

_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_STEP = re.compile(
    rf"""\.?\[\s*(?:(?P<names>(?:{_QUOTED})(?:\s*,\s*(?:{_QUOTED}))*)|(?P<slice>-?\d*\s*:\s*-?\d*(?:\s*:\s*-?\d*)?)|(?P<index>-?\d+)|(?P<star>\*))\s*\]
    |(?P<down>\.\.)|\.(?P<dot_star>\*)|\.?(?P<name>[^.\[\]\s*'"]+)""",
    re.X,
)
_TEST = re.compile(rf"""\s*(?:(?P<text>{_QUOTED})|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)\b|(?P<mark>&&|\|\||==|!=|<=|>=|[=<>!()&|])|(?P<path>@(?:\.[\w\-]+|\[\s*(?:{_QUOTED}|\d+)\s*\])*))""")
_COMPARE = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Slice:
    start: int | None
    stop: int | None
    step: int


@dataclass(frozen=True)
class Names:
    names: tuple[str, ...]


@dataclass(frozen=True)
class Where:
    test: tuple


#: Steps that are no names or indexes: any element, any child, all that is below.
EACH, CHILD, DOWN = None, "*", ".."


@dataclass(frozen=True)
class Sign:
    kind: str


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


def parse_path(path: str) -> list:
    """Names, indexes, None for [*], and the other steps as objects."""
    text, at, out = path.strip(), 0, []
    if text.startswith("$"):
        at = 1
    while at < len(text):
        if start := re.compile(r"\.?\[\s*\?").match(text, at):
            test = _Test(text, start.end())
            out.append(Where(test.read()))
            at = test.at
            continue
        m = _STEP.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"this path isn't supported: {path!r}")
        if m["names"]:
            names = tuple(_unquoted(q) for q in re.findall(_QUOTED, m["names"]))
            out.append(names[0] if len(names) == 1 else Names(names))
        elif m["slice"]:
            parts = [int(p) if p.strip() else None for p in m["slice"].split(":")]
            step = parts[2] if len(parts) > 2 and parts[2] is not None else 1
            if step == 0:
                raise ValueError(f"a slice's step is zero: {path!r}")
            out.append(Slice(parts[0], parts[1], step))
        elif m["index"]:
            i = int(m["index"])
            out.append(i if i >= 0 else Slice(i, i + 1 or None, 1))
        elif m["down"]:
            out.append(Sign(DOWN))
        elif m["dot_star"]:
            out.append(Sign(CHILD))
        else:
            out.append(EACH if m["star"] else m["name"])
        at = m.end()
        if m["down"] and text[at : at + 1] == "*":
            out.append(Sign(CHILD))
            at += 1
    if out and out[-1] == Sign(DOWN):
        raise ValueError(f"nothing follows '..': {path!r}")
    return out


class _Test:
    """A filter's condition, from after '[?' to after ']'."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def token(self, *marks: str):
        m = _TEST.match(self.text, self.at)
        if m and (m["mark"] in marks if marks else not m["mark"]):
            self.at = m.end()
            return m
        return None

    def read(self) -> tuple:
        test = self.either()
        end = re.compile(r"\s*\]").match(self.text, self.at)
        if not end:
            raise ValueError(f"this filter isn't supported: {self.text!r}")
        self.at = end.end()
        return test

    def either(self) -> tuple:
        left = self.both()
        while self.token("||", "|"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.one()
        while self.token("&&", "&"):
            left = ("and", left, self.one())
        return left

    def one(self) -> tuple:
        if self.token("!"):
            return ("not", self.one())
        if self.token("("):
            inner = self.either()
            if not self.token(")"):
                raise ValueError(f"a bracket is missing: {self.text!r}")
            return inner
        left = self.value()
        compare = self.token(*_COMPARE)
        return (compare["mark"], left, self.value()) if compare else ("there", left)

    def value(self) -> tuple:
        m = self.token()
        if not m:
            raise ValueError(f"this filter isn't supported: {self.text!r}")
        if m["path"]:
            return ("path", tuple(parse_path("$" + m["path"][1:])))
        if m["text"]:
            return ("text", _unquoted(m["text"]))
        return ("number", float(m["number"])) if m["number"] else ("word", m["word"])


def _plain(step) -> bool:
    return isinstance(step, str | int)


def _spelled(steps) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _at(node: Column, steps) -> Column:
    return F.get_json_object(node, _spelled(steps)) if steps else node


def _items(node: Column) -> Column:
    """The elements of a list; NULL if the node is none."""
    return F.when(node.startswith("["), F.from_json(node, "array<string>"))


def _fields(node: Column) -> Column:
    """The values of an object; NULL if the node is none."""
    return F.when(node.startswith("{"), F.map_values(F.from_json(node, "map<string,string>")))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _elements(node: Column) -> Column:
    """The elements of a list, or else the node itself, unless it is empty."""
    empty = node.isNull() | node.isin("", "{}", "false")
    return F.coalesce(_items(node), F.when(empty, _nothing()).otherwise(F.array(node)))


def _children(node: Column) -> Column:
    return F.coalesce(_items(node), _fields(node), _nothing())


def _sliced(items: Column, s: Slice) -> Column:
    """As Python slices: bounds count from the end if negative."""
    n = F.size(items)

    def bound(b: int, low: Column, high: Column) -> Column:
        return F.greatest(low, F.least(high, F.lit(b) if b >= 0 else n + b))

    zero, none = F.lit(0), F.lit(-1)
    if s.step > 0:
        start = zero if s.start is None else bound(s.start, zero, n)
        stop = n if s.stop is None else bound(s.stop, zero, n)
        return F.filter(items, lambda _, i: (i >= start) & (i < stop) & ((i - start) % s.step == 0))
    start = n - 1 if s.start is None else bound(s.start, none, n - 1)
    stop = none if s.stop is None else bound(s.stop, none, n - 1)
    return F.reverse(F.filter(items, lambda _, i: (i <= start) & (i > stop) & ((start - i) % -s.step == 0)))


def _below(node: Column) -> Column:
    """The node and all nodes below it, level by level; a document is no deeper than it has brackets."""
    levels = F.length(node) - F.length(F.translate(node, "{[", ""))
    first = F.array(node).cast("array<string>")
    start = F.struct(first.alias("level"), first.alias("found"))

    def down(have: Column, _: Column) -> Column:
        level = F.filter(F.flatten(F.transform(have["level"], _children)), lambda n: n.isNotNull())
        return F.when(F.size(have["level"]) == 0, have).otherwise(F.struct(level.alias("level"), F.concat(have["found"], level).alias("found")))

    return F.when(node.rlike(r"^[\[{]"), F.aggregate(F.sequence(F.lit(0), levels), start, down)["found"]).otherwise(first)


def _typed(value: tuple, node: Column) -> tuple[Column, Column, Column]:
    """A value's kind (NULL: not there), its number and its text."""
    kind, v = value
    if kind == "path" and v:
        found = F.try_variant_get(F.try_parse_json(node), _spelled(v), "variant")
        name = F.schema_of_variant(found)
        is_number = name.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        kind = F.when(is_number, "number").when(name == "STRING", "text").when(name == "BOOLEAN", "word").when(name == "VOID", "word").otherwise(name)
        text = F.when(name == "VOID", "null").otherwise(F.try_variant_get(found, "$", "string"))
        return F.when(found.isNotNull(), kind), F.when(is_number, F.try_variant_get(found, "$", "double")), text
    if kind == "path":  # a node itself has lost its quotes: what looks like a number is one
        number = node.try_cast("double")
        return F.when(number.isNotNull(), "number").when(node.isin("true", "false"), "word").when(node.isNotNull(), "text"), number, node
    return F.lit(kind), F.lit(v if kind == "number" else None).cast("double"), F.lit(None if kind == "number" else v).cast("string")


def _holds(test: tuple, node: Column) -> Column:
    kind = test[0]
    if kind == "not":
        return ~_holds(test[1], node)
    if kind in ("or", "and"):
        a, b = (_holds(t, node) for t in test[1:])
        return a | b if kind == "or" else a & b
    if kind == "there":
        return _typed(test[1], node)[0].isNotNull()
    (k, n, t), (l, m, u) = (_typed(v, node) for v in test[1:])
    compare = _COMPARE[kind]
    same = F.when((k == "number") & (l == "number"), compare(n, m)).when(k == l, compare(t, u))
    return F.coalesce(same, F.lit(kind == "!=") & (k.isNotNull() | l.isNotNull()))


def _stepped(node: Column, step) -> Column:
    """An array of the nodes that one step finds from a node."""
    if step is EACH:
        return _elements(node)
    if isinstance(step, Slice):
        return _sliced(_elements(node), step)
    if isinstance(step, Names):
        return F.filter(F.array(*(_at(node, [n]) for n in step.names)), lambda n: n.isNotNull())
    if isinstance(step, Where):
        return F.filter(_children(node), lambda n: F.coalesce(_holds(step.test, n), F.lit(False)))
    return _below(node) if step.kind == DOWN else _children(node)


def _each(found: Column, f, x) -> Column:
    return F.transform(found, lambda n: f(n, x))


def nodes(document: Column, steps: list) -> Column:
    """An array of the nodes that a path finds."""
    found, at = None, 0
    while at < len(steps) or found is None:
        end = at
        while end < len(steps) and _plain(steps[end]):
            end += 1
        run = steps[at:end]
        if found is None:
            found = F.filter(F.array(_at(document, run)), lambda n: n.isNotNull())
        elif run:
            found = F.filter(_each(found, _at, run), lambda n: n.isNotNull())
        if end < len(steps):
            found = F.flatten(_each(found, _stepped, steps[end]))
        at = end + 1
    return found


def contexts(document: Column, iterator: str) -> Column:
    """A single node that is a list gives its elements."""
    found = nodes(document, parse_path(iterator))
    return F.when(F.size(found) == 1, F.coalesce(_items(found[0]), found)).otherwise(found)


def extracted(context: Column, query: str) -> Column:
    """The lexical forms of a query's values."""
    steps = parse_path(query)
    found = nodes(context, steps)
    flat = F.flatten(F.transform(found, lambda n: F.coalesce(_items(n), F.array(n))))
    flat = F.transform(flat, lambda n: F.when(n.startswith("{") & F.try_parse_json(n).isNotNull(), F.lit(None).cast("string")).otherwise(n))
    # A number that the parser prints with an exponent, as Python prints it.
    flat = F.transform(flat, lambda n: F.when(n.rlike(r"^-?\d\.\d+E-?\d+$"), double_text(n.try_cast("double"))).otherwise(n))
    if not steps or not all(map(_plain, steps)):
        return flat
    is_null = F.coalesce(F.is_variant_null(F.try_variant_get(F.try_parse_json(context), _spelled(steps), "variant")), F.lit(False))
    none = F.array(F.lit(None).cast("string"))
    return F.when(F.size(found) > 0, flat).when(is_null, none).otherwise(flat)


class _Json(Reader):
    def documents(self, spark) -> DataFrame:
        """A column `document`."""
        raise NotImplementedError

    def arrays(self, spark, iterator: str, mappings: dict[str, str]) -> DataFrame:
        """A row for each context, with an array of each attribute's values."""
        df = self.documents(spark).select(F.explode(contexts(F.col("document"), iterator or "$")).alias("context"))
        return df.select(*(extracted(F.col("context"), q).alias(a) for a, q in mappings.items()))

    def read(self, spark, iterator: str, mappings: dict[str, str], strict: bool = False) -> tuple[DataFrame, dict[str, Val]]:
        df = self.documents(spark).select(F.explode(contexts(F.col("document"), iterator or "$")).alias("context"))
        df = explode_all(df, {a: extracted(F.col("context"), q) for a, q in mappings.items()}, strict)
        return df, {a: Val(F.col(f"`{a}`")) for a in mappings}


@dataclass(frozen=True)
class JsonFile(_Json):
    """A document in each file, or with lines=True in each line."""

    path: str
    lines: bool = False

    def documents(self, spark):
        text = spark.read.text(self.path, wholetext=not self.lines)
        return text.where(F.trim("value") != "").select(F.col("value").alias("document"))

    def facts(self):
        return [("path", self.path)]


@dataclass(frozen=True)
class JsonColumn(_Json):
    """A document in each row of a column of a Parquet table."""

    folder: str
    table: str
    column: str

    def documents(self, spark):
        return spark.read.parquet(f"{self.folder}/{self.table}.parquet").select(F.col(self.column).alias("document"))

    def facts(self):
        return [("table_name", self.table), ("column", self.column)]
