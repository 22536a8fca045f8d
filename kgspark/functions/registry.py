"""Functions by URI: builders of columns, or Python functions that run as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions import terms as T
from kgspark.functions.terms import Val

FUNCTIONS = "http://kgspark.example/functions#"
CONDITIONS = "http://example.com/idlab/function/"
#: Identifiers that subject_for_row and graph_for_source make start with these; set them to what your graphs use.
BASES = {"id": "https://kgspark.example/id/", "graph": "https://kgspark.example/graph/"}
#: What stands for a missing identifier.
ERROR_MARKERS = ("http://error", "error", "<http://error>")


class FunctionRegistry:
    """URI to function. Builders take and give Val or Column; Python functions take strings (None for epsilon) and give one."""

    _found: dict[str, tuple[str, Callable]] = {}

    @classmethod
    def register(cls, uri: str, function: Callable, kind: str = "python") -> None:
        """kind: 'column' for a builder, else 'python'."""
        if kind not in ("column", "python"):
            raise ValueError(kind)
        cls._found[uri] = (kind, function)

    @classmethod
    def unregister(cls, uri: str) -> None:
        cls._found.pop(uri, None)

    @classmethod
    def get(cls, uri: str) -> tuple[str, Callable] | None:
        """By the URI; a builtin also by its local name in any namespace that ends in 'functions#'."""
        if uri in cls._found:
            return cls._found[uri]
        space, mark, name = uri.rpartition("#")
        return cls._found.get(FUNCTIONS + name) if mark and space.endswith("functions") else None

    @classmethod
    def list_registered(cls) -> list[str]:
        return sorted(cls._found)

    @classmethod
    def call(cls, uri: str, args: list[Val]) -> Val:
        found = cls.get(uri)
        if found is None:
            return T.null_val()  # as an error in evaluation
        kind, f = found
        if kind == "column":
            out = f(*args)
            return out if isinstance(out, Val) else Val(out.cast("string"), "literal", T.STRING)
        return Val(_udf(f)(*(T.to_lexical(a) for a in args)), "literal", T.STRING)


def _udf(f: Callable) -> Callable[..., Column]:
    import pandas as pd

    def safe(*row):
        try:
            out = f(*(None if x is None or x != x else x for x in row))
            return None if out is None else ("true" if out else "false") if isinstance(out, bool) else str(out)
        except Exception:
            return None  # epsilon

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([safe(*row) for row in zip(*columns, strict=True)], dtype=object)

    def wrapped(*args: Column) -> Column:
        if not args:
            return F.lit(safe())
        # A function of a known number of series, as type hints are read from it.
        names = ", ".join(f"a{i}: pd.Series" for i in range(len(args)))
        space: dict = {"run": run, "pd": pd}
        exec(f"def batch({names}) -> pd.Series:\n    return run({', '.join(f'a{i}' for i in range(len(args)))})", space)  # noqa: S102
        return F.pandas_udf(space["batch"], "string")(*args)

    return wrapped


def _text(v: Val) -> Column:
    """The lexical form, empty for epsilon."""
    return F.coalesce(T.to_lexical(v), F.lit(""))


def true_condition(*args: Val) -> Val:
    found = F.lit(False)
    for a in args:
        found = found | (_text(a) != "")
    return Val(found.cast("string"))


def equal(a: Val, b: Val) -> Val:
    return Val((_text(a) == _text(b)).cast("string"))


def not_equal(a: Val, b: Val) -> Val:
    return Val((_text(a) != _text(b)).cast("string"))


#: Media types by extension.
MEDIA_TYPES = {
    ".csv": "text/csv", ".json": "application/json", ".jsonld": "application/ld+json", ".nq": "application/n-quads",
    ".nt": "application/n-triples", ".ttl": "text/turtle", ".xml": "application/xml",
}


def get_mime_type(name: Val) -> Val:
    # The last part's extension; leading dots do not begin one.
    ext = F.regexp_extract(F.lower(_text(name)), r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)
    out = F.lit("application/octet-stream")
    for k, v in MEDIA_TYPES.items():
        out = F.when(ext == k, v).otherwise(out)
    return Val(out)


def _unwrapped(v: Val) -> Column:
    c = _text(v)
    return F.when(c.startswith("<") & c.endswith(">"), F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def _is_error(c: Column) -> Column:
    return (c == "") | F.trim(F.lower(c)).isin(*ERROR_MARKERS)


def subject_for_row(doi: Val, ident: Val, fallback: Val) -> Val:
    parts = [_unwrapped(x) for x in (doi, ident, fallback)]
    found = F.coalesce(*(F.when(p != "", p) for p in parts), F.lit(""))
    hashed = F.concat(F.lit(BASES["id"]), F.sha2(F.concat_ws("|", *parts), 256))
    out = (
        F.when(_is_error(found), hashed)
        .when(found.startswith("http://") | found.startswith("https://"), found)
        .when(found.startswith("10."), F.concat(F.lit("https://doi.org/"), found))
        .otherwise(F.concat(F.lit(BASES["id"]), T.quote(found)))
    )
    return Val(out, "iri")


def graph_for_source(source: Val, ident: Val, year: Val) -> Val:
    name = F.when(_text(source) == "", "unknown").otherwise(_text(source))
    rest = [F.when(~_is_error(_text(x)), T.quote(_text(x))) for x in (ident, year)]
    return Val(F.concat(F.lit(BASES["graph"]), F.concat_ws("/", name, *rest)), "iri")


BUILTINS = {
    "concat": T.concat,
    "toIRI": T.to_iri,
    "toLiteral": T.to_literal,
    "toBNode": T.to_bnode,
    "toLiteralLang": T.to_literal_lang,
    "percentEncodeComponent": T.percent_encode_component,
    "subject_for_row": subject_for_row,
    "graph_for_source": graph_for_source,
}
#: Arguments of these, from the second on, are Python values, not columns.
PLAIN_ARGUMENTS = {"toIRI", "toLiteral", "toLiteralLang"}
for _name, _f in BUILTINS.items():
    FunctionRegistry.register(FUNCTIONS + _name, _f, "column")
for _name, _f in {"trueCondition": true_condition, "equal": equal, "notEqual": not_equal, "getMIMEType": get_mime_type}.items():
    FunctionRegistry.register(CONDITIONS + _name, _f, "column")

__all__ = ["BASES", "BUILTINS", "CONDITIONS", "FUNCTIONS", "FunctionRegistry"]
