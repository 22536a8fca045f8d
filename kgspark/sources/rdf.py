"""RDF as a source: small local graphs, and SPARQL queries over them or over an endpoint."""

from __future__ import annotations

import json
import logging
import os
import re
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import Val
from kgspark.sources.base import Reader, plain_name

TIMEOUT = 10  # seconds


def graph_frame(spark, text: str, base: str = "http://example.com/base/", graph: str | None = None) -> DataFrame:
    """A Turtle document as rows of N-Triples text."""
    from kgspark.plans import turtle

    rows = [(*(_text(t) for t in triple), graph) for triple in turtle.parse(text, base)]
    return spark.createDataFrame(rows, "subject string, predicate string, object string, graph string")


def _text(t) -> str:
    from kgspark.functions.terms import IRI, STRING, BlankNode

    if isinstance(t, IRI):
        return f"<{t.value}>"
    if isinstance(t, BlankNode):
        return f"_:{t.value}"
    body = t.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{body}"@{t.lang}' if t.lang else f'"{body}"' if t.datatype == STRING else f'"{body}"^^<{t.datatype}>'


@dataclass(frozen=True)
class SparqlSource(Reader):
    """Rows are solutions. resource<N>.ttl beside the mapping answers for a source whose IRI ends in N; else the endpoint does."""

    endpoint: str
    query: str
    directory: str = "."
    name: str = ""
    single_valued = True

    def facts(self):
        return [("endpoint", self.endpoint), ("query", self.query)]

    def _solutions(self, spark) -> DataFrame:
        from kgspark.sparql import parse_select, select

        plan = parse_select(self.query)
        number = re.search(r"(\d+)$", self.name)
        local = os.path.join(self.directory, f"resource{number[1] if number else 1}.ttl")
        if os.path.exists(local):
            with open(local, encoding="utf-8") as f:
                return select(graph_frame(spark, f.read()), self.query)
        names = plan.variables()
        rows = [tuple(b.get(v, {}).get("value") for v in names) for b in self._remote()]
        return spark.createDataFrame(rows, ", ".join(f"`{v}` string" for v in names)) if names else spark.range(0)

    def _remote(self) -> list[dict]:
        if ":PORT" in self.endpoint or not self.endpoint.startswith(("http://", "https://")):
            return []
        data = urllib.parse.urlencode({"query": self.query}).encode()
        request = urllib.request.Request(self.endpoint, data, {"Accept": "application/sparql-results+json"})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:  # noqa: S310
                return json.load(answer)["results"]["bindings"]
        except (OSError, ValueError, KeyError) as e:
            logging.getLogger(__name__).warning("no answer from %s: %s", self.endpoint, e)
            return []

    def read(self, spark, iterator: str, mappings: dict[str, str], strict: bool = False, keep_missing: bool = False) -> tuple[DataFrame, dict[str, Val]]:
        from kgspark.sparql import lexical

        df = self._solutions(spark)
        values = {}
        for a, q in mappings.items():
            name = plain_name(q).removesuffix(".value").lstrip("?")
            values[a] = Val(lexical(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("string"))
        if not keep_missing:
            for v in values.values():
                df = df.where(v.lex.isNotNull())
        return df, values
