"""A Turtle reader for mapping documents and small local graphs, on the driver."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from kgspark.functions.terms import IRI, RDF, XSD, BlankNode, Literal

Term = IRI | Literal | BlankNode
Triple = tuple[Term, Term, Term]

_TOKEN = re.compile(
    r"""(?P<space>[\s]+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:prefix\b|base\b)(?=\s+[\w.\-]*:?\s*<))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w][\w.\-]*(?<!\.))
    |(?P<name>(?:[A-Za-z][\w\-.]*(?<!\.))?:(?:[\w:](?:[\w.\-:]|%[0-9A-Fa-f]{2}|\\.)*(?<!\.))?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>\^\^|[.;,()\[\]{}])""",
    re.X | re.S,
)
_ESCAPE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPE.get(m[1], m[0]), s, flags=re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: {text[at : at + 30]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str, base: str):
        self.tokens, self.at, self.base = tokens(text), 0, base
        self.prefixes: dict[str, str] = {}
        self.triples: list[Triple] = []
        self.blanks = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def expect(self, mark: str) -> None:
        got = self.next()
        if got[1] != mark:
            raise TurtleError(f"{mark!r} is missing before {got[1]!r}")

    def fresh(self) -> BlankNode:
        self.blanks += 1
        return BlankNode(f"g{self.blanks}")

    def iri(self, text: str) -> IRI:
        value = unescape(text[1:-1])
        if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", value):
            value = urljoin(self.base, value) if not value.startswith("#") else self.base.split("#")[0] + value
        return IRI(value)

    def named(self, text: str) -> IRI:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"no prefix {prefix!r}")
        return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    def document(self) -> None:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive":
                self.next()
                if "prefix" in text.lower():
                    name = self.next()[1].rstrip(":")
                    self.prefixes[name] = self.iri(self.next()[1]).value
                else:
                    self.base = self.iri(self.next()[1]).value
                if self.peek()[1] == ".":
                    self.next()
                continue
            subject = self.node()
            if self.peek()[1] != "." or kind != "mark":
                self.properties(subject)
            self.expect(".")

    def properties(self, subject: Term) -> None:
        while True:
            if self.peek()[1] in ("]", ".", "}"):
                return
            kind, text = self.peek()
            predicate = IRI(RDF + "type") if text == "a" and kind == "word" else None
            if predicate:
                self.next()
            else:
                predicate = self.node()
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()

    def node(self) -> Term:
        kind, text = self.next()
        if kind == "iri":
            return self.iri(text)
        if kind == "name":
            return self.named(text)
        if kind == "blank":
            return BlankNode(text[2:])
        if kind == "string":
            body = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
            value = unescape(body)
            kind, text = self.peek()
            if kind == "lang":
                self.next()
                return Literal(value, lang=text[1:])
            if text == "^^":
                self.next()
                kind, text = self.next()
                return Literal(value, (self.iri(text) if kind == "iri" else self.named(text)).value)
            return Literal(value)
        if kind == "number":
            return Literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            return Literal(text, XSD + "boolean")
        if text == "[":
            made = self.fresh()
            self.properties(made)
            self.expect("]")
            return made
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.next()
            head: Term = IRI(RDF + "nil")
            for item in reversed(items):
                cell = self.fresh()
                self.triples += [(cell, IRI(RDF + "first"), item), (cell, IRI(RDF + "rest"), head)]
                head = cell
            return head
        raise TurtleError(f"not expected: {text!r}")


def parse(text: str, base: str = "http://example.com/base/") -> list[Triple]:
    reader = _Reader(text.lstrip("﻿"), base)
    reader.document()
    return reader.triples


def base_of(text: str) -> str | None:
    """The document's own base, if it names one in its first part."""
    m = re.search(r"(?:@base|\bBASE)\s+<([^>]+)>", text[:1024])
    return m[1] if m else None
