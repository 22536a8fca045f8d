"""RDF terms as columns.

A value is a lexical column with a kind that is known when the plan is built; epsilon, the error value, is NULL.
Kinds: 'iri', 'literal', 'bnode' are terms; 'raw' is data that has not been made a term. Relations that mix kinds
hold terms as structs (kind, value, datatype, lang), see TERM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RR = "http://www.w3.org/ns/r2rml#"
STRING, LANG_STRING = XSD + "string", RDF + "langString"
TERM = "struct<kind:string,value:string,datatype:string,lang:string>"
LETTER = {"iri": "I", "literal": "L", "bnode": "B", "raw": "R"}


@dataclass(frozen=True)
class Val:
    """lex: string column; of kind 'term', a TERM struct. datatype: an IRI, or a column where it varies.
    shape: what is known of the text when the plan is built: its constant parts, with 'x' for each part that is percent-encoded."""

    lex: Column
    kind: str = "raw"
    datatype: Column | str | None = None
    lang: Column | str | None = None
    shape: str | None = None
    clean: bool = False  # nothing in it to escape: the text of a number, a date or a truth value
    native: Column | None = None  # the whole number, never NULL, that lex is the text of; joins compare it instead
    there: Column | None = None  # whether lex has a value, where that is known without making lex


def column(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string") if x is None else F.lit(x)


def let(c: Column, body) -> Column:
    """body(c), with c computed once, however often body uses it."""
    return F.transform(F.array(c), body)[0]


def xsd_of(value) -> str:
    """The datatype of a Python value: of a truth value, a whole number or a number with a point; all else is a string."""
    kinds = {bool: "boolean", int: "integer", float: "double"}
    return XSD + kinds.get(type(value), "string")


def null_val(kind: str = "raw") -> Val:
    return Val(F.lit(None).cast("string"), kind)


@dataclass(frozen=True)
class IRI:
    value: str

    def __post_init__(self):
        if not self.value or not re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", self.value):
            raise ValueError(f"no IRI: {self.value!r}")


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = STRING
    lang: str | None = None

    def __post_init__(self):
        if self.lang is not None:
            if not re.match(r"^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{1,8})*$", self.lang):
                raise ValueError(f"no language tag: {self.lang!r}")
            if self.datatype not in (STRING, LANG_STRING):
                raise ValueError("a literal with a language has no other datatype")
            object.__setattr__(self, "datatype", LANG_STRING)


@dataclass(frozen=True)
class BlankNode:
    value: str


def constant(v) -> Val:
    """A term or a Python value."""
    if isinstance(v, IRI):
        return Val(F.lit(v.value), "iri", shape=v.value)
    if isinstance(v, Literal):
        return Val(F.lit(v.value), "literal", v.datatype, v.lang or None, v.value)
    if isinstance(v, BlankNode):
        return Val(F.lit(v.value), "bnode")
    if v is None:
        return null_val()
    return Val(F.lit(("true" if v else "false") if isinstance(v, bool) else str(v)))


def as_struct(v: Val) -> Column:
    if v.kind == "term":
        return v.lex
    none = F.lit(None).cast("string")
    made = F.struct(
        F.lit(LETTER[v.kind]).alias("kind"),
        v.lex.alias("value"),
        (none if v.kind != "literal" else column(v.datatype or STRING) if not isinstance(v.datatype, Column) else v.datatype).alias("datatype"),
        column(v.lang).alias("lang"),
    )
    return F.when(v.lex.isNotNull(), made)


def to_lexical(v: Val) -> Column:
    """The lexical form; a blank node has none."""
    if v.kind == "bnode":
        return F.lit(None).cast("string")
    if v.kind == "term":
        return F.when(v.lex["kind"] != "B", v.lex["value"])
    return v.lex


# Percent-encoding. url_encode leaves letters, digits and -._* and makes a space '+'.


def quote(c: Column, safe: str = "") -> Column:
    """UTF-8 percent-encoding of all but unreserved characters and those in safe."""
    if "*" in safe:
        safe = safe.replace("*", "")
        out = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    else:
        out = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for s in [x for x in safe if x not in "-._~%"] + ["%"] * ("%" in safe):
        out = F.replace(out, F.lit(f"%{ord(s):02X}"), F.lit(s))
    return out


_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
#: IRIs that stay as they are.
_PLAIN = r"^[a-z][a-z0-9+.\-]*:(//[^/?#]*)?[A-Za-z0-9/:@;,%._~\-]*(\?[A-Za-z0-9=&?/:,;@%._~\-]+)?(#[A-Za-z0-9;@,/?%._~\-]+)?$"
_ABSOLUTE = r"""^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]+.*|//[^/?#]*/.*|(?!//)[^?#].*)$"""
_ILLEGAL = r"""[\p{IsWhite_Space}\x1c-\x1f<>"{}|\\^`]"""


def _parts(c: Column, path: str, query: str, fragment: str) -> Column:
    """An IRI with a scheme, each component encoded."""
    x = lambda i: F.regexp_extract(c, _PARTS, i)
    q, f = quote(x(6), query), quote(x(8), fragment)
    return F.concat(F.lower(x(1)), F.lit(":"), x(2), quote(x(4), path), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), F.when(f != "", F.concat(F.lit("#"), f)).otherwise(""))


def iri_text(c: Column, shape: str | None = None) -> Column:
    """An IRI between < and >, with its components encoded; existing encodings stay."""
    if shape is not None and re.match(_PLAIN, shape):
        return F.concat(F.lit("<"), c, F.lit(">"))
    encoded = lambda x: F.when(x.rlike(_PARTS), _parts(x, "/:@;,%", "=&?/:,;@%", ";@,/?%")).otherwise(quote(x, "/:@;,%"))
    return F.concat(F.lit("<"), let(c, lambda x: F.when(x.rlike(_PLAIN), x).otherwise(encoded(x))), F.lit(">"))


def is_absolute(c: Column) -> Column:
    return c.rlike(_ABSOLUTE) & ~c.rlike(_ILLEGAL)


def _encoded(c: Column) -> Column:
    """A template's result, encoded but for its encodings."""
    safe = "/-._~!$&'\"()*+,;=:@%"
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), _parts(c, safe, "=&?" + safe, "%")).otherwise(quote(c, "/-._~%"))


def _joined(base: str, c: Column) -> Column:
    """A relative reference resolved against a base that is known."""
    root = urlsplit(base)
    host = f"{root.scheme}://{root.netloc}"
    folder = urljoin(base, "x")[:-1]
    path = F.regexp_extract(c, r"^[^?#]*", 0)
    whole = F.when(c.startswith("/"), path).otherwise(F.concat(F.lit(urlsplit(folder).path), path))
    # Segments in turn: '..' takes the one before it away; a last '.' or '..' leaves a folder.
    none = F.array().cast("array<string>")
    steps = F.aggregate(
        F.split(whole, "/", -1), none, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x.isin("", "."), a).otherwise(F.concat(a, F.array(x)))
    )
    ended = F.when(whole.rlike(r"(^|/)\.{0,2}$") & (F.size(steps) > 0), F.lit("/")).otherwise(F.lit(""))
    dotted = F.concat(F.lit(host + "/"), F.array_join(steps, "/"), ended, F.regexp_extract(c, r"[?#](?s:.*)$", 0))
    return (
        F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), c)
        .when(c == "", F.lit(base))
        .when(c.startswith("//"), F.concat(F.lit(root.scheme + ":"), c))
        .when(c.rlike(r"^[^?#]*(?<![^/])\.\.?(?![^/?#])"), dotted)
        .when(c.startswith("/"), F.concat(F.lit(host), c))
        .when(c.startswith("?"), F.concat(F.lit(base.split("?")[0].split("#")[0]), c))
        .when(c.startswith("#"), F.concat(F.lit(base.split("#")[0]), c))
        .otherwise(F.concat(F.lit(folder), c))
    )


def to_iri(v: Val, base: str | None = None, template_mode: bool = True) -> Val:
    """An absolute legal IRI as it is; else, of a template, encoded and resolved; of a reference, base + value if that is absolute and legal."""
    if v.shape is not None and v.kind != "bnode" and re.match(_PLAIN, v.shape) and re.match(r"[^:]+:(//[^/?#]|(?!//)[^?#])", v.shape):
        return Val(v.lex, "iri", shape=v.shape)

    def made(lex: Column) -> Column:
        if not template_mode:
            rest = let(F.concat(F.lit(base), lex), lambda x: F.when(is_absolute(x), x)) if base else F.lit(None).cast("string")
        elif base:
            rest = let(_encoded(lex), lambda x: _joined(base, x))
        else:
            rest = let(_encoded(lex), lambda x: F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), x))
        return F.when(is_absolute(lex), lex).otherwise(rest)

    return Val(let(to_lexical(v), made), "iri")


def to_literal(v: Val, datatype: str = STRING) -> Val:
    if v.kind == "literal" and datatype == STRING:
        return v
    if v.kind == "term":
        same = (v.lex["kind"] == "L") if datatype == STRING else F.lit(False)
        made = as_struct(Val(to_lexical(v), "literal", datatype))
        return Val(F.when(same, v.lex).otherwise(made), "term")
    return Val(to_lexical(v), "literal", datatype, shape=v.shape)


def to_literal_lang(v: Val, lang: str) -> Val:
    Literal("x", lang=lang)
    return Val(to_lexical(v), "literal", LANG_STRING, lang)


def to_bnode(v: Val) -> Val:
    lex = to_lexical(v)
    label = F.regexp_replace(lex, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return Val(F.when(label.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), label).otherwise(F.concat(F.lit("b"), F.sha2(lex, 256))), "bnode")


def concat(*args: Val) -> Val:
    shape = "".join(a.shape for a in args) if all(a.shape is not None for a in args) else None
    return Val(F.concat(*map(to_lexical, args)) if args else F.lit(""), "literal", STRING, shape=shape)


def percent_encode_component(v: Val) -> Val:
    lex = to_lexical(v)
    if isinstance(v.datatype, str) and v.datatype in (XSD + "integer", XSD + "boolean") and v.clean:
        return Val(lex, "literal", STRING, shape="x")  # nothing to encode
    return Val(quote(lex), "literal", STRING, shape="x")


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def term_text(v: Val, position: str = "object") -> Column:
    """N-Triples text; NULL if the kind does not fit the position: a subject is no literal, a predicate or graph is an IRI."""
    allowed = {"subject": ("iri", "bnode"), "predicate": ("iri",), "object": ("iri", "bnode", "literal"), "graph": ("iri",)}[position]
    if v.kind == "term":
        s = v.lex
        out = F.lit(None).cast("string")
        for kind in allowed:
            part = Val(s["value"], kind, s["datatype"], s["lang"])
            out = F.when(s["kind"] == LETTER[kind], _text(part)).otherwise(out)
        return out
    return _text(v) if v.kind in allowed else F.lit(None).cast("string")


def _text(v: Val) -> Column:
    if v.kind == "iri":
        return iri_text(v.lex, v.shape)
    if v.kind == "bnode":
        return F.concat(F.lit("_:"), v.lex)
    kind = v.datatype or STRING if not isinstance(v.datatype, Column) else v.datatype
    if isinstance(kind, str):
        end = F.lit('"' if kind == STRING else f'"^^<{kind}>')
    else:
        end = F.when(kind == STRING, '"').otherwise(F.concat(F.lit('"^^<'), kind, F.lit(">")))
    if v.lang is not None:
        end = F.lit(f'"@{v.lang}') if isinstance(v.lang, str) else F.when(v.lang.isNotNull(), F.concat(F.lit('"@'), v.lang)).otherwise(end)
    plain = isinstance(kind, str) and kind.startswith(XSD) and kind != STRING and v.shape is None and not isinstance(v.lang, (str, Column))
    return F.concat(F.lit('"'), v.lex if plain and v.clean else escaped(v.lex), end)


def to_rdflib(term):
    """A driver-side term as one of the rdflib package, which is imported here only. Epsilon is None; what is no term stays."""
    if term is None:
        return None
    import rdflib

    if isinstance(term, IRI):
        return rdflib.URIRef(term.value)
    if isinstance(term, BlankNode):
        return rdflib.BNode(term.value)
    if isinstance(term, Literal):
        return rdflib.Literal(term.value, lang=term.lang) if term.lang else rdflib.Literal(term.value, datatype=rdflib.URIRef(term.datatype))
    return term


# Natural typing of table columns.


def double_text(c: Column) -> Column:
    """A double as Python prints it: plain in [1e-4, 1e16), else with a signed exponent of two digits."""
    text, size = c.cast("string"), F.abs(c)
    digits = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    power = F.regexp_extract(text, r"E(-?)(\d+)$", 2)
    sign = F.when(F.regexp_extract(text, r"E(-?)", 1) == "-", "-").otherwise("+")
    far = F.concat(F.regexp_replace(F.regexp_extract(text, r"^([^E]*)E", 1), r"\.0$", ""), F.lit("e"), sign, F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
    special = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(special, F.when((c == 0) | (size >= 1e-3) & (size < 1e7), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(far))


def natural(c: Column, kind: str) -> Val:
    """The natural literal of a column of a Spark type."""
    base = kind.split("(")[0]
    text = c.cast("string")
    if base in ("tinyint", "smallint", "int", "bigint"):
        return Val(text, "literal", XSD + "integer", clean=True, native=c.cast("bigint"))
    if base in ("float", "double"):
        return Val(double_text(c.cast("double")), "literal", XSD + "double", clean=True)
    if base in ("decimal", "boolean", "date"):
        return Val(text, "literal", XSD + base, clean=True)
    if base.startswith("timestamp"):
        # Most moments are whole seconds, which a cast prints without a formatter.
        text = F.when(F.extract(F.lit("SECONDS"), c) % 1 == 0, F.replace(text, F.lit(" "), F.lit("T"))).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        return Val(text, "literal", XSD + "dateTime", clean=True)
    if base == "binary":
        return Val(F.hex(c), "literal", STRING)
    stamp = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$"
    moment, day = F.try_to_timestamp(F.replace(text, F.lit(" "), F.lit("T"))).isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
    kind_of = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & day, XSD + "date").when(text.rlike(stamp) & moment, XSD + "dateTime").otherwise(STRING)
    lex = F.when(text.rlike(stamp) & moment, F.replace(text, F.lit(" "), F.lit("T"))).when(text.rlike(r"^\\x[0-9A-Fa-f]*$"), F.upper(F.substring(text, F.lit(3), F.length(text)))).otherwise(text)
    return Val(lex, "literal", kind_of)
