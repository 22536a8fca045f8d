"""XML files: the iterator's path names the rows; children and @attributes are extracted, each with all its values.

Rows of `.//name` come from Spark's reader, which splits files. Other paths (steps, `*`, `..`, predicates [n], [@a], [@a='v'], [name], [name='v']) are
followed in a file as a whole, one file after the other in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.terms import Val
from kgspark.sources.base import Reader, explode_all


@dataclass(frozen=True)
class XmlFile(Reader):
    path: str

    def facts(self):
        return [("path", self.path)]

    def arrays(self, spark, iterator: str, mappings: dict[str, str]) -> DataFrame:
        """A row for each element, with an array of each attribute's values."""
        if tag := re.fullmatch(r"\.//([A-Za-z_][\w.\-]*)", iterator.strip()):  # large files are split at such rows
            df = spark.read.format("xml").option("rowTag", tag[1]).option("inferSchema", False).option("ignoreSurroundingSpaces", False).load(self.path)
            return df.select(*(_values(df.schema, q).alias(a) for a, q in mappings.items()))
        check_path(iterator)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column("content"):
                    found = elements(ElementTree.fromstring(content.as_py()), iterator)
                    columns = [pa.array([texts(e, q) for e in found], pa.list_(pa.string())) for q in mappings.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), *columns], ["nth", *mappings])

        strings = T.ArrayType(T.StringType())
        kind = T.StructType([T.StructField("nth", T.LongType()), *(T.StructField(a, strings) for a in mappings)])
        files = spark.read.format("binaryFile").load(self.path).select("content")  # a row for each file
        return files.mapInArrow(run, kind).select(*(F.col(f"`{a}`") for a in mappings) or [F.lit(1).alias("one")])

    def read(self, spark, iterator: str, mappings: dict[str, str], strict: bool = False) -> tuple[DataFrame, dict[str, Val]]:
        df = self.arrays(spark, iterator or ".", mappings)
        df = explode_all(df, {a: F.col(f"`{a}`") for a in mappings}, strict)
        return df, {a: Val(F.col(f"`{a}`")) for a in mappings}


def check_path(path: str) -> None:
    """Refuses a path with steps or predicates that are not known."""
    try:
        ElementTree.Element("x").findall(path.strip().lstrip("/") or ".")
    except (SyntaxError, KeyError) as e:
        raise ValueError(f"this path isn't known: {path}") from e


def elements(root: ElementTree.Element, iterator: str) -> list[ElementTree.Element]:
    """The elements of a path from the root element. An absolute one begins with the root's own name, or with a child's, or anywhere, or else its last step alone names the rows."""
    path = iterator.strip()
    if not path.startswith("/"):
        return root.findall(path or ".")
    path = path.lstrip("/")
    first, _, rest = path.partition("/")
    tries = [rest or "."] if first == root.tag and not iterator.strip().startswith("//") else []
    tries += [path, f".//{path}", f".//{path.rpartition('/')[2]}"] if path else ["."]
    return next((found for p in tries if (found := root.findall(p))), [])


def texts(element: ElementTree.Element, query: str) -> list[str]:
    """The non-empty texts, or the attributes, at a path from an element; none if the path isn't known."""
    path, _, last = re.sub(r"^\$\.?", "", query).rpartition("/")
    try:
        if last.startswith("@"):
            return [v for e in (element.findall(path) if path else [element]) if (v := e.get(last[1:])) is not None]
        path = path if last == "text()" else f"{path}/{last}" if path else last
        return [e.text for e in element.findall(path or ".") if e.text]
    except (SyntaxError, KeyError):
        return []


def _each(found: Column, name: str) -> Column:
    return F.transform(found, lambda x: x[name])


def _values(schema: T.StructType, query: str) -> Column:
    """An array of the non-empty texts at a path."""
    query = re.sub(r"^\$\.?", "", query)
    steps = [s for s in re.split(r"/+", query) if s not in ("", ".")] or ["_VALUE"]
    none = F.array().cast("array<string>")
    found, kind = None, schema
    for step in steps:
        name = "_" + step[1:] if step.startswith("@") else "_VALUE" if step == "text()" else re.sub(r"\[.*\]$", "", step)
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return none if name != "_VALUE" or found is None else _texts(found, kind)
        field = kind[name].dataType
        many = isinstance(field, T.ArrayType)
        if found is None:
            c = F.col(f"`{name}`")
            found = F.when(c.isNotNull(), c if many else F.array(c))
        else:
            inner = _each(found, name)
            found = F.flatten(F.filter(inner, lambda x: x.isNotNull())) if many else inner
        kind = field.elementType if many else field
    return _texts(found, kind)


def _texts(found: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        if "_VALUE" not in kind.names:
            return F.array().cast("array<string>")
        found = F.transform(found, lambda x: x["_VALUE"])
    out = F.transform(found, lambda x: x.cast("string"))
    return F.coalesce(F.filter(out, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
