"""A subset of SPARQL over quads as DataFrames, and SERVICE-CALL.

SELECT [DISTINCT] of basic graph patterns, property paths, GRAPH, OPTIONAL, UNION, MINUS, VALUES, BIND, FILTER, [NOT] EXISTS,
subqueries, aggregates, GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET. A group's parts are taken by kind: values, patterns, optional
parts and MINUS, BIND, filters. An unbound variable is compatible with any term.
Rows of a graph are subject, predicate, object, graph as N-Triples text; solutions are columns of such text.
"""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.terms import double_text

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>[?$]\w+)
    |(?P<lang>@[A-Za-z][A-Za-z0-9\-]*)|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z][\w\-]*:[\w\-.]*(?<!\.)|:[\w\-]+|_:\w+)|(?P<word>[A-Za-z_][\w\-]*)
    |(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}().;,*=<>!+\-/\[\]|^?])""",
    re.X,
)


class SparqlError(ValueError):
    pass


@dataclass
class Select:
    names: list[str] | None  # None: *
    distinct: bool
    where: list
    made: dict[str, tuple] = field(default_factory=dict)  # expressions of names
    group: list = field(default_factory=list)  # of name and expression
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0

    def variables(self) -> list[str]:
        return self.names if self.names is not None else _mentioned(self.where)


def _mentioned(parts: list) -> list[str]:
    out: dict[str, None] = {}
    for kind, *x in parts:
        if kind == "triple":
            out |= dict.fromkeys(t[1:] for t in x[0] if t.startswith("?"))
        elif kind == "closure":
            out |= dict.fromkeys(t[1:] for t in (x[0], x[2]) if t.startswith("?"))
        elif kind == "sub":
            out |= dict.fromkeys(x[0].variables())
        elif kind == "graph":
            out |= dict.fromkeys([x[0][1:]] if x[0].startswith("?") else []) | dict.fromkeys(_mentioned(x[1]))
        elif kind in ("optional", "group"):
            out |= dict.fromkeys(_mentioned(x[0]))
        elif kind == "union":
            for g in x[0]:
                out |= dict.fromkeys(_mentioned(g))
        elif kind == "values":
            out |= dict.fromkeys(x[0])
        elif kind == "bind":
            out[x[1]] = None
    return list(out)


class _Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"not expected: {text[at : at + 30]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.hidden, self.prefixes, self.base = 0, 0, {"": "", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": "http://www.w3.org/2001/XMLSchema#"}, ""

    def peek(self, offset: int = 0) -> tuple[str, str]:
        return self.items[self.at + offset] if self.at + offset < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.peek(-1)

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        if kind == "word" and text.upper() in words:
            self.at += 1
            return True
        return False

    def mark(self, mark: str) -> bool:
        if self.peek() == ("mark", mark):
            self.at += 1
            return True
        return False

    def expect(self, mark: str) -> None:
        if not self.mark(mark):
            raise SparqlError(f"{mark!r} is missing before {self.peek()[1]!r}")

    def query(self) -> Select:
        while True:
            if self.word("PREFIX"):
                name = self.next()[1]
                if self.peek() == ("mark", ":"):
                    self.next()
                self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
            elif self.word("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                break
        out = self.select()
        if self.peek()[0] != "end":
            raise SparqlError(f"not expected: {self.peek()[1]!r}")
        return out

    def select(self) -> Select:
        if not self.word("SELECT"):
            raise SparqlError("only SELECT queries are known")
        distinct, names, made = self.word("DISTINCT", "REDUCED"), [], {}
        while self.peek()[0] == "var" or self.peek() == ("mark", "("):
            if self.peek()[0] == "var":
                names.append(self.next()[1][1:])
            else:
                e, name = self.named()
                names.append(name)
                made[name] = e
        if len(set(names)) < len(names):
            raise SparqlError("a variable is selected twice")
        if not names:
            self.expect("*")
        while self.word("FROM"):
            self.word("NAMED")
            self.next()
        self.word("WHERE")
        out = Select(names or None, distinct, self.group(), made)
        if self.word("GROUP"):
            self.by("GROUP")
            while self.peek()[0] == "var" or self.peek() == ("mark", "("):
                if self.peek()[0] == "var":
                    name = self.next()[1]
                    out.group.append((name[1:], ("term", "?" + name[1:])))
                else:
                    e, name = self.named()
                    out.group.append((name, e))
        if self.word("HAVING"):
            out.having.append(self.expression())
            while self.peek() == ("mark", "("):
                out.having.append(self.expression())
        if self.word("ORDER"):
            self.by("ORDER")
            while True:
                down = self.word("DESC")
                if not down and not self.word("ASC") and self.peek()[0] != "var" and self.peek() != ("mark", "("):
                    break
                out.order.append((self.primary(), down))
        while self.peek()[0] == "word":
            if self.word("LIMIT"):
                out.limit = int(self.next()[1])
            elif self.word("OFFSET"):
                out.offset = int(self.next()[1])
            else:
                break
        return out

    def by(self, word: str) -> None:
        if not self.word("BY"):
            raise SparqlError(f"{word} without BY")

    def named(self) -> tuple[tuple, str]:
        """(expression AS ?name)"""
        self.expect("(")
        e = self.expression()
        if not self.word("AS") or self.peek()[0] != "var":
            raise SparqlError("AS and a variable are missing")
        name = self.next()[1][1:]
        self.expect(")")
        return e, name

    def group(self) -> list:
        self.expect("{")
        out: list = []
        if self.peek()[0] == "word" and self.peek()[1].upper() == "SELECT":
            out.append(("sub", self.select()))
            self.expect("}")
            return out
        while not self.mark("}"):
            if self.word("GRAPH"):
                name = self.term()
                out.append(("graph", name, self.group()))
            elif self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("FILTER"):
                exists = self.exists()
                out.append(exists or ("filter", self.expression()))
            elif self.word("BIND"):
                out.append(("bind", *self.named()))
            elif self.word("VALUES"):
                out.append(self.values())
            elif self.peek() == ("mark", "{"):
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            elif not self.mark("."):
                self.triples(out)
        return out

    def exists(self) -> tuple | None:
        ahead = [t[1].upper() for t in (self.peek(), self.peek(1))]
        if ahead[0] != "EXISTS" and ahead != ["NOT", "EXISTS"]:
            return None
        wanted = not self.word("NOT")
        self.next()
        return ("exists", self.group(), wanted)

    def values(self) -> tuple:
        many = self.mark("(")
        names = []
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
            if not many:
                break
        if many:
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.mark("}"):
            if many:
                self.expect("(")
            row = [None if self.word("UNDEF") else self.term() for _ in names]
            rows.append(tuple(row))
            if many:
                self.expect(")")
        return ("values", names, rows)

    def triples(self, out: list) -> None:
        subject = self.term()
        while True:
            predicate = ("iri", self.term()) if self.peek()[0] == "var" else self.path()
            while True:
                out += self.along(subject, predicate, self.term())
                if not self.mark(","):
                    break
            if not self.mark(";"):
                break
            if self.peek()[1] in (".", "}"):
                break
        self.mark(".")

    def path(self) -> tuple:
        parts = [self.way()]
        while self.mark("|"):
            parts.append(self.way())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def way(self) -> tuple:
        parts = [self.step()]
        while self.mark("/"):
            parts.append(self.step())
        return ("seq", parts) if len(parts) > 1 else parts[0]

    def step(self) -> tuple:
        if self.mark("^"):
            return ("back", self.step())
        if self.mark("!"):
            bracket, none = self.mark("("), [self.edge()]
            while bracket and self.mark("|"):
                none.append(self.edge())
            if bracket:
                self.expect(")")
            return ("none", none)
        if self.mark("("):
            out = self.path()
            self.expect(")")
        else:
            out = ("iri", self.edge())
        for mark, zero, many in (("?", True, False), ("*", True, True), ("+", False, True)):
            if self.mark(mark):
                return ("closure", out, zero, many)
        return out

    def edge(self) -> str:
        if self.peek() == ("word", "a"):
            self.next()
            return f"<{self.prefixes['rdf']}type>"
        out = self.term()
        if not out.startswith("<"):
            raise SparqlError(f"not a predicate: {out}")
        return out

    def fresh(self) -> str:
        self.hidden += 1
        return f"?__path{self.hidden}"

    def along(self, subject: str, path: tuple, target: str) -> list:
        """The parts of a group that a path stands for."""
        kind, x, *more = path
        if kind == "iri":
            return [("triple", (subject, x, target))]
        if kind == "back":
            return self.along(target, x, subject)
        if kind == "alt":
            return [("union", [self.along(subject, p, target) for p in x])]
        if kind == "seq":
            ends = [subject, *(self.fresh() for _ in x[1:]), target]
            return [part for a, p, b in zip(ends, x, ends[1:], strict=False) for part in self.along(a, p, b)]
        if kind == "none":
            edge = self.fresh()
            return [("group", [("triple", (subject, edge, target)), *(("filter", ("!=", ("term", edge), ("term", i))) for i in x)])]
        return [("closure", subject, self.along("?__from", x, "?__to"), target, *more)]

    def term(self) -> str:
        kind, text = self.next()
        if kind == "var":
            return "?" + text[1:]
        if kind == "iri":
            return text if ":" in text or not self.base else f"<{self.base}{text[1:-1]}>"
        if kind == "name":
            if text.startswith("_:"):
                return "?__" + text[2:]
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"no prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{local}>"
        if kind == "string":
            body = '"' + text[1:-1].replace('"', '\\"') + '"' if text[0] == "'" else text
            if self.peek()[0] == "lang":
                return body + self.next()[1]
            if self.mark("^^"):
                datatype = self.term()
                return body if datatype == f"<{self.prefixes['xsd']}string>" else f"{body}^^{datatype}"
            return body
        if kind == "number":
            return f'"{text}"^^<{self.prefixes["xsd"]}{"decimal" if "." in text else "integer"}>'
        if kind == "word" and text in ("true", "false"):
            return f'"{text}"^^<{self.prefixes["xsd"]}boolean>'
        raise SparqlError(f"not expected: {text!r}")

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.mark("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.comparison()
        while self.mark("&&"):
            left = ("and", left, self.comparison())
        return left

    def comparison(self) -> tuple:
        left = self.sum()
        kind, text = self.peek()
        if kind == "mark" and text in ("=", "!=", "<", ">", "<=", ">="):
            self.next()
            return (text, left, self.sum())
        wanted = not (text.upper() == "NOT" and self.peek(1)[1].upper() == "IN" and self.next())
        if self.word("IN"):
            self.expect("(")
            test = ("in", left, self.listed())
            return test if wanted else ("not", test)
        return left

    def listed(self) -> list:
        """Expressions and commas up to a closing bracket."""
        out: list = []
        while not self.mark(")"):
            out.append(self.expression())
            self.mark(",")
        return out

    def sum(self) -> tuple:
        left = self.product()
        while self.peek() in (("mark", "+"), ("mark", "-")):
            left = (self.next()[1], left, self.product())
        return left

    def product(self) -> tuple:
        left = self.primary()
        while self.peek() in (("mark", "*"), ("mark", "/")):
            left = (self.next()[1], left, self.primary())
        return left

    def primary(self) -> tuple:
        if self.mark("!"):
            return ("not", self.primary())
        if self.mark("-"):
            return ("-", ("term", f'"0"^^<{self.prefixes["xsd"]}integer>'), self.primary())
        if self.mark("+"):
            return self.primary()
        if self.mark("("):
            e = self.expression()
            self.expect(")")
            return e
        if self.peek()[0] == "word" and self.peek(1) == ("mark", "("):
            name = self.next()[1].upper()
            self.expect("(")
            return self.aggregate(name) if name in _AGGREGATES else ("call", name, self.listed())
        if self.peek()[0] in ("name", "iri") and self.peek(1) == ("mark", "("):
            name = self.term()
            self.expect("(")
            return ("call", name, self.listed())
        return ("term", self.term())

    def aggregate(self, name: str) -> tuple:
        distinct = self.word("DISTINCT")
        e = None if name == "COUNT" and self.mark("*") else self.expression()
        between = " "
        if name == "GROUP_CONCAT" and self.mark(";"):
            if not self.word("SEPARATOR"):
                raise SparqlError("SEPARATOR is missing")
            self.expect("=")
            between = _constant(("term", self.term()))
        self.expect(")")
        return ("aggregate", name, distinct, e, between)


def parse_select(text: str) -> Select:
    if not text.strip():
        raise SparqlError("an empty query")
    return _Parser(text).query()


def lexical(c: Column) -> Column:
    """The IRI or the literal's lexical form of N-Triples text."""
    body = F.regexp_extract(c, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).when(c.startswith('"'), body).otherwise(c)


def _literal(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


_XSD = "http://www.w3.org/2001/XMLSchema#"
_AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")
_COMPARISONS = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
#: Terms of numeric datatypes: whole numbers, decimals, and floating ones.
_WHOLE = r"\^\^<http://www\.w3\.org/2001/XMLSchema#(integer|(unsigned|)(long|int|short|byte)|(non|)(positive|negative)Integer|(nonNegative|nonPositive)Integer)>$"
_DECIMAL = r"\^\^<http://www\.w3\.org/2001/XMLSchema#decimal>$"
_FLOATING = r"\^\^<http://www\.w3\.org/2001/XMLSchema#(double|float)>$"


def _rank(c: Column) -> Column:
    """0, 1 and 2 for whole, decimal and floating numbers; NULL for what is no number."""
    good = lexical(c).try_cast("double").isNotNull()
    return F.when(good, F.when(c.rlike(_WHOLE), 0).when(c.rlike(_DECIMAL), 1).when(c.rlike(_FLOATING), 2))


def _number(rank: Column, whole: Column, decimal: Column, floating: Column) -> Column:
    """The term of a number that was calculated in the three ways."""
    plain = F.regexp_replace(F.regexp_replace(decimal.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    terms = ((whole.cast("string"), "integer"), (plain, "decimal"), (double_text(floating), "double"))
    made = [F.concat(F.lit('"'), text, F.lit(f'"^^<{_XSD}{name}>')) for text, name in terms]
    return F.when(rank == 0, made[0]).when(rank == 1, made[1]).when(rank == 2, made[2])


def _calculated(sign: str, a: Column, b: Column) -> Column:
    x, y = lexical(a), lexical(b)
    rank = F.when(_rank(a).isNotNull() & _rank(b).isNotNull(), F.greatest(_rank(a), _rank(b)))
    ways = []
    for kind in ("decimal(38,0)", "decimal(38,12)", "double"):
        p, q = x.try_cast(kind), y.try_cast(kind)
        ways.append({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[sign](p, q))
    return _number(F.greatest(rank, F.lit(1)) if sign == "/" else rank, *ways)  # a quotient is no whole number


def _order(c: Column) -> list[Column]:
    """What terms are sorted by: unbound, blank nodes, IRIs, literals; numbers by value, all else by lexical form."""
    kind = F.when(c.isNull(), 0).when(c.startswith("_:"), 1).when(c.startswith("<"), 2).otherwise(3)
    number = F.when(_rank(c).isNotNull(), lexical(c).try_cast("double"))
    return [kind, number, lexical(c)]


def _value(e: tuple, have: list[str]) -> Column:
    """An expression as text; truth values are booleans."""
    kind = e[0]
    if kind == "term":
        t = e[1]
        return (F.col(f"`{t[1:]}`") if t[1:] in have else F.lit(None).cast("string")) if t.startswith("?") else F.lit(t)
    if kind in ("or", "and"):
        a, b = (_truth(x, have) for x in e[1:])
        return a | b if kind == "or" else a & b
    if kind == "not":
        return ~_truth(e[1], have)
    if kind == "call":
        if e[1] == "IF":
            return F.when(_truth(e[2][0], have), _term_of(e[2][1], have)).otherwise(_term_of(e[2][2], have))
        return _call(e[1], [_term_of(a, have) for a in e[2]], e[2])
    if kind == "in":
        return reduce(lambda x, y: x | y, (_value(("=", e[1], one), have) for one in e[2]), F.lit(False))
    if kind == "aggregate":
        raise SparqlError(f"an aggregate doesn't belong here: {e[1]}")
    a, b = _term_of(e[1], have), _term_of(e[2], have)
    if kind in ("+", "-", "*", "/"):
        return _calculated(kind, a, b)
    # Numbers, by their datatype, by value; all else by lexical form; equal terms are equal.
    x, y = lexical(a), lexical(b)
    n, m = (F.when(_rank(t).isNotNull(), v.try_cast("double")) for t, v in ((a, x), (b, y)))
    compare = _COMPARISONS[kind]
    return F.when(n.isNotNull() & m.isNotNull(), compare(n, m)).otherwise(compare(a, b) if kind in ("=", "!=") else compare(x, y))


_TESTS = ("SAMETERM", "BOUND", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "REGEX", "CONTAINS", "STRSTARTS", "STRENDS")


def _is_test(e: tuple) -> bool:
    return e[0] in ("or", "and", "not", "in", *_COMPARISONS) or e[0] == "call" and e[1] in _TESTS


def _term_of(e: tuple, have: list[str]) -> Column:
    """An expression as a term."""
    c = _value(e, have)
    return F.when(c.isNotNull(), F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{_XSD}boolean>'))) if _is_test(e) else c


def _truth(e: tuple, have: list[str]) -> Column:
    c = _value(e, have)
    if _is_test(e):
        return c
    x = lexical(c)
    return (x != "") & (x != "false") & F.coalesce(x.try_cast("double") != 0, F.lit(True))


def _call(name: str, args: list[Column], raw: list) -> Column:
    x = [lexical(a) for a in args]
    if name == "BOUND":
        return args[0].isNotNull()
    if name == "STR":
        return _literal(x[0])
    if name == "LANG":
        return _literal(F.regexp_extract(args[0], r'"@([A-Za-z0-9\-]+)$', 1))
    if name in ("ISIRI", "ISURI"):
        return args[0].startswith("<")
    if name == "ISLITERAL":
        return args[0].startswith('"')
    if name == "ISBLANK":
        return args[0].startswith("_:")
    if name == "REGEX":
        pattern, flags = (_constant(r) for r in (raw[1], raw[2] if len(raw) > 2 else ("term", '""')))
        return x[0].rlike(("(?i)" if "i" in flags else "") + pattern)
    if name == "CONTAINS":
        return F.contains(x[0], x[1])
    if name == "STRSTARTS":
        return F.startswith(x[0], x[1])
    if name == "STRENDS":
        return F.endswith(x[0], x[1])
    if name == "CONCAT":
        return _literal(F.concat(*x))
    if name in ("IRI", "URI"):
        return F.concat(F.lit("<"), x[0], F.lit(">"))
    if name == "UCASE":
        return _literal(F.upper(x[0]))
    if name == "LCASE":
        return _literal(F.lower(x[0]))
    if name == "COALESCE":
        return F.coalesce(*args)
    if name == "ISNUMERIC":
        return F.when(args[0].isNotNull(), _rank(args[0]).isNotNull())
    if name == "DATATYPE":
        typed = F.regexp_extract(args[0], r"\^\^(<[^<>]*>)$", 1)
        return F.when(args[0].startswith('"'), F.when(typed != "", typed).when(args[0].rlike(r'"@[A-Za-z0-9\-]+$'), f"<{_LANG_STRING}>").otherwise(f"<{_XSD}string>"))
    if name == "STRLEN":
        return _whole(F.char_length(x[0]))
    if name == "SUBSTR":
        start = x[1].try_cast("int")
        return _literal(F.substring(x[0], start, x[2].try_cast("int") if len(x) > 2 else F.char_length(x[0])))
    if name == "REPLACE":
        flags = _constant(raw[3]) if len(raw) > 3 else ""
        return _literal(F.regexp_replace(x[0], F.lit(("(?i)" if "i" in flags else "") + _constant(raw[1])), x[2]))
    if name in ("STRBEFORE", "STRAFTER"):
        at = F.instr(x[0], x[1])
        return _literal(F.when(at == 0, "").otherwise(F.substring(x[0], F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(x[0], at + F.char_length(x[1]), F.char_length(x[0]))))
    if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
        f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)"))}[name]
        floating = {"ROUND": lambda c: F.floor(c + 0.5)}.get(name, f)(x[0].try_cast("double")).cast("double")
        return _number(_rank(args[0]), f(x[0].try_cast("decimal(37,0)")), f(x[0].try_cast("decimal(36,12)")), floating)
    if name == "YEAR":
        return _whole(F.regexp_extract(x[0], r"^(-?\d{4,})-", 1).try_cast("int"))
    if name == "SAMETERM":
        return args[0] == args[1]
    if name.startswith(f"<{_XSD}"):
        kind = name[len(_XSD) + 1 : -1]
        if kind == "string":
            return _literal(x[0])
        if kind in ("integer", "int", "long"):
            return _whole(F.regexp_extract(x[0], r"^\s*([+-]?\d+)", 1).try_cast("decimal(38,0)"))
        if kind in ("decimal", "double", "float"):
            rank = F.lit(1 if kind == "decimal" else 2)
            n = x[0].try_cast("decimal(38,12)")
            return _number(rank, n, n, x[0].try_cast("double"))
        if kind == "boolean":
            b = x[0].try_cast("boolean")
            return F.when(b.isNotNull(), F.concat(F.lit('"'), b.cast("string"), F.lit(f'"^^<{_XSD}boolean>')))
    raise SparqlError(f"this function isn't known: {name}")


_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"


def _whole(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{_XSD}integer>')))


def _constant(e: tuple) -> str:
    if e[0] != "term" or not e[1].startswith('"'):
        raise SparqlError("a constant string is needed")
    return re.sub(r"\\(.)", r"\1", e[1][1 : e[1].rindex('"')])


def _all(df: DataFrame, tests: list) -> DataFrame:
    return reduce(lambda d, t: d.where(_truth(t, d.columns)), tests, df)


def _beside(left: DataFrame, right: DataFrame, tests: list, maybe: set[str], how: str) -> DataFrame:
    """A left, semi or anti join; filters of the right part see both sides' variables and decide on what joins."""
    shared = [c for c in left.columns if c in right.columns and c != _ONE]
    named = right.select(*(F.col(f"`{c}`").alias(f"__right_{c}" if c in left.columns else c) for c in right.columns))
    on = F.lit(True)
    for c in shared:
        a, b = F.col(f"`{c}`"), F.col(f"`__right_{c}`")
        on = on & ((a == b) | a.isNull() | b.isNull() if c in maybe else a == b)
    for t in tests:
        on = on & F.coalesce(_truth(t, [*left.columns, *right.columns]), F.lit(False))
    if not shared and not tests and how != "left":
        named = named.limit(1)  # whether there is a solution at all
    out = left.join(named, on, how)
    if how != "left":
        return out
    return out.select(*(F.coalesce(f"`{c}`", f"`__right_{c}`").alias(c) if c in maybe and c in shared else F.col(f"`{c}`") for c in left.columns), *(F.col(f"`{c}`") for c in right.columns if c not in left.columns))


def _join(left: DataFrame, right: DataFrame, maybe: set[str]) -> DataFrame:
    """Solutions that agree. A variable that a side may lack is compatible with any term there: such rows join by the others."""
    shared = [c for c in left.columns if c in right.columns]
    open_ones = [c for c in shared if c in maybe]
    if open_ones:
        c = open_ones[0]
        a, b, rest = (left.where(F.col(f"`{c}`").isNotNull()), right.where(F.col(f"`{c}`").isNotNull()), maybe - {c})
        sides = [(a, b), (left.where(F.col(f"`{c}`").isNull()).drop(c), right), (a, right.where(F.col(f"`{c}`").isNull()).drop(c))]
        return reduce(lambda x, y: x.unionByName(y), (_join(x, y, rest) for x, y in sides))
    return left.join(right, shared) if shared else left.crossJoin(right)


#: The column of solutions without variables.
_ONE = "__one"
_RANK = {"values": 0, "optional": 2, "minus": 2, "bind": 3, "filter": 4, "exists": 4}


@dataclass
class _Solver:
    """Groups over quads. as_set: it doesn't matter how often a solution is there, so that no pattern needs a distinct."""

    quads: DataFrame
    as_set: bool = False

    def one(self) -> DataFrame:
        return self.quads.sparkSession.range(1).select(F.lit(1).alias(_ONE))

    def pattern(self, terms: tuple[str, str, str], graph: str | None) -> DataFrame:
        pairs = list(zip(("subject", "predicate", "object"), terms, strict=True))
        df = self.quads
        if graph is not None:
            pairs.append(("graph", graph))
            df = df.where(F.col("graph").isNotNull())
        bound: dict[str, str] = {}
        for column, t in pairs:
            if not t.startswith("?"):
                df = df.where(F.col(column) == t)
            elif t[1:] in bound:
                df = df.where(F.col(column) == F.col(bound[t[1:]]))
            else:
                bound[t[1:]] = column
        out = df.select(*(F.col(c).alias(v) for v, c in bound.items())) if bound else df.select(F.lit(1).alias(_ONE))
        return out.distinct() if graph is None and not self.as_set else out

    def group(self, parts: list, graph: str | None) -> tuple[DataFrame, set[str]]:
        """Solutions, and the variables that some may lack."""
        df: DataFrame | None = None
        maybe: set[str] = set()
        # Values first: they are small, and bind what patterns filter by.
        for kind, *x in sorted(parts, key=lambda p: _RANK.get(p[0], 1)):
            if kind == "filter" and df is not None:
                df = _all(df, x)
            elif kind in ("optional", "minus", "exists"):
                right, lacking = self.group([p for p in x[0] if kind == "minus" or p[0] != "filter"], graph)
                tests = [p[1] for p in x[0] if p[0] == "filter" and kind != "minus"]
                df = self.one() if df is None else df
                if kind == "optional":
                    new = set(right.columns) - set(df.columns)
                    df = _beside(df, right, tests, maybe | lacking, "left")
                    maybe |= new
                elif kind == "exists":
                    df = _beside(df, right, tests, maybe | lacking, "left_semi" if x[1] else "left_anti")
                elif set(df.columns) & set(right.columns) - {_ONE}:  # MINUS of solutions that share no variable takes nothing
                    df = self.minus(df, right, maybe | lacking)
            elif kind in ("bind", "filter"):
                df = self.one() if df is None else df
                df = df.withColumn(x[1], _term_of(x[0], df.columns).cast("string")) if kind == "bind" else _all(df, x)
                maybe |= {x[1]} if kind == "bind" else set()
            else:
                new, lacking = self.part(kind, x, graph)
                maybe |= lacking
                df = new if df is None else _join(df, new, maybe)
            df = df.drop(_ONE) if len(df.columns) > 1 else df
        return (df if df is not None else self.one()), maybe & set(df.columns if df is not None else ())

    def minus(self, left: DataFrame, right: DataFrame, maybe: set[str]) -> DataFrame:
        shared = [c for c in left.columns if c in right.columns]
        if not maybe & set(shared):
            return left.join(right, shared, "left_anti")
        named = right.select(*(F.col(f"`{c}`").alias(f"__right_{c}") for c in shared))
        pairs = [(F.col(f"`{c}`"), F.col(f"`__right_{c}`")) for c in shared]
        agree = reduce(lambda a, b: a & b, ((a == b) | a.isNull() | b.isNull() for a, b in pairs))
        met = reduce(lambda a, b: a | b, (a.isNotNull() & b.isNotNull() for a, b in pairs))
        return left.join(named, agree & met, "left_anti")

    def part(self, kind: str, x: list, graph: str | None) -> tuple[DataFrame, set[str]]:
        if kind == "values":
            rows = self.quads.sparkSession.createDataFrame(x[1], ", ".join(f"`{n}` string" for n in x[0]))
            return F.broadcast(rows), {n for i, n in enumerate(x[0]) if any(r[i] is None for r in x[1])}  # as many rows as the query spells out
        if kind == "triple":
            return self.pattern(x[0], graph), set()
        if kind == "graph":
            return self.group(x[1], x[0])
        if kind == "group":
            return self.group(x[0], graph)
        if kind == "sub":
            return _Solver(self.quads).select(x[0], graph)
        if kind == "closure":
            return self.closure(*x, graph), set()
        both = [self.group(g, graph) for g in x[0]]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d for d, _ in both))
        return out, {c for c in out.columns if any(c not in d.columns or c in m for d, m in both)}

    def closure(self, subject: str, inner: list, target: str, zero: bool, many: bool, graph: str | None) -> DataFrame:
        """Pairs that a path of any length joins, found step by step from the end that is known."""
        group = [graph[1:]] if graph is not None and graph.startswith("?") else []
        edges = _Solver(self.quads, True).group(inner, graph)[0].select("__from", "__to", *group).distinct()
        back = subject.startswith("?") and not target.startswith("?")
        if back:
            edges = edges.select(F.col("__to").alias("__from"), F.col("__from").alias("__to"), *group)
            subject, target = target, subject
        reach = edges if subject.startswith("?") else edges.where(F.col("__from") == subject)
        if many:
            reach = _reached(reach, edges, group)
        if zero:
            source = self.quads if graph is None else self.quads.where(F.col("graph").isNotNull() if group else F.col("graph") == graph)
            names = [F.col("graph").alias(g) for g in group]
            if not subject.startswith("?"):
                where = source.select(*names).distinct() if group else self.one()
                same = where.select(F.lit(subject).alias("__from"), F.lit(subject).alias("__to"), *group)
            else:
                ends = source.select("subject", *names).union(source.select("object", *names)).distinct()
                same = ends.select(F.col("subject").alias("__from"), F.col("subject").alias("__to"), *group)
            reach = reach.unionByName(same).distinct()
        columns = {}
        for column, t in (("__from", subject), ("__to", target)):
            if not t.startswith("?"):
                reach = reach.where(F.col(column) == t)
            elif t[1:] in columns:
                reach = reach.where(F.col(column) == F.col("__from"))
            else:
                columns[t[1:]] = column
        for g in group:
            if g in columns:
                reach = reach.where(F.col(columns[g]) == F.col(f"`{g}`"))
        names = [F.col(c).alias(v) for v, c in columns.items()] + [F.col(f"`{g}`") for g in group if g not in columns]
        return reach.select(*names) if names else reach.select(F.lit(1).alias(_ONE))

    def select(self, plan: Select, graph: str | None = None) -> tuple[DataFrame, set[str]]:
        df, maybe = self.group(plan.where, graph)
        found: list[tuple] = []
        made = {n: _without(e, found) for n, e in plan.made.items()}
        having = [_without(e, found) for e in plan.having]
        order = [(_without(e, found), down) for e, down in plan.order]
        if found or plan.group:
            if plan.names is None:
                raise SparqlError("SELECT * of groups")
            keys = [n for n, _ in plan.group]
            for name, e in plan.group:
                if e != ("term", "?" + name) or name not in df.columns:
                    df = df.withColumn(name, _term_of(e, df.columns).cast("string"))
            for name in plan.names:
                if name not in keys and name not in made:
                    raise SparqlError(f"?{name} is neither grouped by nor aggregated")
            columns = [_aggregate(e, df.columns).alias(f"__made{i}") for i, e in enumerate(found)] or [F.count(F.lit(1)).alias(_ONE)]
            df = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*columns)
            maybe &= set(keys)
        for name, e in made.items():
            df = df.withColumn(name, _term_of(e, df.columns).cast("string"))
            maybe.add(name)
        df = _all(df, having)
        names = plan.variables()
        columns = [F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names if not n.startswith("__")]

        def ordered(d: DataFrame) -> DataFrame:
            keys = [(F.desc if down else F.asc)(k) for e, down in order for k in _order(_term_of(e, d.columns))]
            return d.orderBy(*keys) if keys else d

        out = ordered(df.select(*columns).distinct()) if plan.distinct else ordered(df).select(*columns)
        if plan.offset:
            out = out.offset(plan.offset)
        lacking = {n for n in names if n in maybe or n not in df.columns}
        return (out if plan.limit is None else out.limit(plan.limit)), lacking


def _without(e: tuple, found: list[tuple]) -> tuple:
    """An expression with variables in place of its aggregates, which found gets."""
    if e[0] == "aggregate":
        if e not in found:
            found.append(e)
        return ("term", f"?__made{found.index(e)}")
    return tuple(_without(x, found) if isinstance(x, tuple) else [_without(y, found) for y in x] if isinstance(x, list) else x for x in e)


def _aggregate(e: tuple, have: list[str]) -> Column:
    _, name, distinct, of, between = e
    if of is None:
        return _whole(F.count_distinct(F.struct(*(F.coalesce(f"`{c}`", F.lit("")) for c in have))) if distinct else F.count(F.lit(1)))
    c = _term_of(of, have)
    if name == "COUNT":
        return _whole(F.count_distinct(c) if distinct else F.count(c))
    if name in ("MIN", "MAX"):
        return (F.min_by if name == "MIN" else F.max_by)(c, F.when(c.isNotNull(), F.struct(*_order(c))))
    if name == "SAMPLE":
        return F.min(c)
    if name == "GROUP_CONCAT":
        return _literal(F.array_join(F.sort_array((F.collect_set if distinct else F.collect_list)(lexical(c))), between))
    # What is no number makes a sum unbound; that of nothing is zero.
    add = F.sum_distinct if distinct else F.sum
    x, rank = lexical(c), _rank(c)
    sums = [add(x.try_cast(kind)) for kind in ("decimal(28,0)", "decimal(28,12)", "double")]
    n = F.count_distinct(c) if distinct else F.count(c)
    top = F.when(F.count(c) == F.count(rank), F.coalesce(F.max(rank), F.lit(0)))
    if name == "SUM":
        return _number(top, F.coalesce(sums[0], F.lit(0)), F.coalesce(sums[1], F.lit(0)), sums[2])
    zero = F.lit(f'"0"^^<{_XSD}integer>')
    return F.when(n == 0, zero).otherwise(_number(F.greatest(top, F.lit(1)), sums[0], F.try_divide(sums[1], n.cast("decimal(20,0)")), F.try_divide(sums[2], n)))


def _cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint, in the shared folder that the session names."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise SparqlError("spark.checkpoint.dir is needed for paths of any length")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kgspark-"))
    return df.checkpoint()


def _reached(start: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """Each step joins what the last one found; the driver sees only whether there was anything."""
    edges = _cut(edges)
    step = edges.select(F.col("__from").alias("__to"), F.col("__to").alias("__next"), *group)
    new = _cut(start)
    found = new
    while not new.isEmpty():
        further = new.join(step, ["__to", *group]).select("__from", F.col("__next").alias("__to"), *group).distinct()
        new = _cut(further.join(found, ["__from", "__to", *group], "left_anti"))
        found = found.unionByName(new)
    return found


def _counts(plan: Select) -> bool:
    found: list[tuple] = []
    for e in [*plan.made.values(), *plan.having, *(e for e, _ in plan.order)]:
        _without(e, found)
    return bool(found or plan.group)


def select(quads: DataFrame, text: str) -> DataFrame:
    plan = parse_select(text)
    return _Solver(quads, plan.distinct and not _counts(plan)).select(plan)[0]


# SERVICE-CALL: BIND SERVICE-CALL(?v, "file") AS ?g runs a mapping for each value of ?v into a graph of its own.

_CALL = re.compile(r"""BIND\s+SERVICE-CALL\s*\(\s*\?(\w+)\s*,\s*["']([^"']+)["']\s*\)\s*AS\s+\?(\w+)\s*\.?""", re.I)


def service_calls(query: str) -> list[tuple[str, str, str]]:
    """variable, file and graph variable of each call."""
    return [m.groups() for m in _CALL.finditer(query)]


def values_of(query: str, variable: str) -> list[str]:
    m = re.search(rf"VALUES\s+\?{variable}\s*\{{([^}}]*)\}}", query, re.I)
    return re.findall(r"<[^>]*>|\"[^\"]*\"|'[^']*'|[^\s<>\"']+", m[1]) if m else []


def token_name(token: str) -> str:
    """The last part of an IRI, or the text itself."""
    return re.split(r"[/#]", token.strip("<>\"'").rstrip("/"))[-1]


def graph_iri(token: str, base: str = "http://example.org/graph/") -> str:
    return token[1:-1] if token.startswith("<") else base + token_name(token)


def mapping_for(token: str, file: str, directory: str) -> str:
    name = token_name(token)
    for path in (file, f"{name}_{file}", os.path.join(name, file)):
        if os.path.exists(os.path.join(directory, path)):
            return os.path.join(directory, path)
    raise FileNotFoundError(f"{file} for {name} in {directory}")


def service_call(spark: SparkSession, query: str, directory: str, quads: DataFrame | None = None, options=None) -> DataFrame:
    """Runs the mappings that a query calls, each into its value's graph, and the query over them and over quads."""
    from kgspark.plans.mapping import Mapping

    data = quads if quads is not None else spark.createDataFrame([], "subject string, predicate string, object string, graph string")
    for variable, file, graph in service_calls(query):
        rows = []
        for token in dict.fromkeys(values_of(query, variable)):
            name = f"<{graph_iri(token)}>"
            made = Mapping.from_file(mapping_for(token, file, directory), options).execute(spark).text()
            data = data.unionByName(made.withColumn("graph", F.lit(name)).distinct())
            rows.append(f"({token if token[0] in '<' + chr(34) + chr(39) else chr(34) + token + chr(34)} {name})")
        query = _CALL.sub(lambda m, g=graph, v=variable, r=rows: f"VALUES (?{v} ?{g}) {{ {' '.join(r)} }}" if (m[1], m[3]) == (v, g) else m[0], query)
        bare = re.search(rf"VALUES\s+\?{variable}\s*\{{[^}}]*\}}", query, re.I)
        query = query.replace(bare[0], "", 1) if bare else query
    return select(data, query)
