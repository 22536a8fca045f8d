"""Units: terms, expressions, operators, sources, mappings, sinks, SPARQL, streams, commands."""

import json
import math
import os
import re
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark import sinks
from kgspark import sources as S
from kgspark.functions import terms as T
from kgspark.functions.registry import FUNCTIONS, FunctionRegistry
from kgspark.functions.terms import IRI, XSD, BlankNode, Literal, Val
from kgspark.plans import turtle
from kgspark.plans.algebra import Constant, EquiJoin, Extend, FunctionCall, Project, Reference, Source, Union
from kgspark.plans.catalogue import PREFIX
from kgspark.plans.mapping import Mapping, MappingError, Options, template_parts
from kgspark.sources.base import MissingReference
from kgspark.sources.json import parse_path
from kgspark.sources.tables import database_kind, jdbc_url, portable, script_types
from kgspark.sparql import SparqlError, graph_iri, parse_select, select, service_calls, token_name, values_of
from kgspark.sources.rdf import graph_frame

EX = "http://example.org/"


def texts(spark, values, build):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(build(Val(F.col("v"))).alias("out")).collect()]


# Terms


def test_term_validation():
    for bad in ("", "no scheme", "1a:b"):
        with pytest.raises(ValueError):
            IRI(bad)
    with pytest.raises(ValueError):
        Literal("x", lang="not a tag")
    with pytest.raises(ValueError):
        Literal("x", XSD + "integer", "en")
    assert Literal("x", lang="en-GB").datatype.endswith("langString")
    assert Literal("1", XSD + "integer") != Literal("01", XSD + "integer")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12), min_size=1, max_size=40))
def test_percent_encoding(spark, values):
    assert texts(spark, values, lambda v: T.percent_encode_component(v).lex) == [urllib.parse.quote(v, safe="") for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12), min_size=1, max_size=40))
def test_escapes_round_trip(spark, values):
    lines = texts(spark, values, lambda v: T.term_text(T.to_literal(v)))
    assert [turtle.unescape(x[1:-1]) for x in lines] == values


def test_python_types():
    assert [T.xsd_of(v).removeprefix(XSD) for v in (True, 1, 1.5, "x", None)] == ["boolean", "integer", "double", "string", "string"]


def test_strict_by_environment(spark, tmp_path, monkeypatch):
    src = Source(S.JsonFile(write(tmp_path / "a.json", '[{"a": 1}]')), "$[*]", (("b", "b"),))
    assert src.execute(spark).df.count() == 0
    monkeypatch.setenv("KGSPARK_STRICT_REFERENCES", "1")
    with pytest.raises(MissingReference):
        src.execute(spark)


def test_iris(spark):
    values = ["http://a/b c", "http://a/b", "urn:x", "a b", "http:", "http://a/é", 'http://a/"q"', None, "x/y", "/root", "?q", "#f", "../up", "//h/p"]
    assert texts(spark, values, lambda v: T.to_iri(v, None, False).lex) == [None, "http://a/b", "urn:x", None, None, "http://a/é", None, *[None] * 7]
    assert texts(spark, values[:7], lambda v: T.to_iri(v).lex) == ["http://a/b%20c", "http://a/b", "urn:x", None, "http:", "http://a/é", 'http://a/"q"']
    base = "http://h.org/d/e"
    relative = ["a b", "x/y", "/root", "?q", "#f", "../up", "./z", "//h/p", ""]
    assert texts(spark, relative[3:4] + relative[5:], lambda v: T.to_iri(v, base).lex)[1:] == [urllib.parse.urljoin(base, x) if x else base for x in relative[5:]]
    assert texts(spark, ["a b", "x"], lambda v: T.to_iri(v, base).lex) == ["http://h.org/d/a%20b", "http://h.org/d/x"]
    assert texts(spark, ["x", "b c"], lambda v: T.to_iri(v, "http://b/", False).lex) == ["http://b/x", None]
    assert texts(spark, ["http://a/b=c?x=1#f g"], lambda v: T.iri_text(v.lex)) == ["<http://a/b%3Dc?x=1#f%20g>"]


def test_blank_nodes_and_positions(spark):
    import hashlib

    assert texts(spark, ["ok_1", " pad ", "no no", None], lambda v: T.to_bnode(v).lex) == ["ok_1", "pad", "b" + hashlib.sha256(b"no no").hexdigest(), None]
    lit = lambda v: T.to_literal(v)
    assert texts(spark, ["x"], lambda v: T.term_text(lit(v), "subject")) == [None]
    assert texts(spark, ["x"], lambda v: T.term_text(v, "object")) == [None]
    assert texts(spark, ["x"], lambda v: T.term_text(T.to_bnode(v), "predicate")) == [None]
    assert texts(spark, ["x"], lambda v: T.term_text(T.to_literal_lang(v, "en"))) == ['"x"@en']
    assert texts(spark, ["x"], lambda v: T.concat(T.to_bnode(v)).lex) == [None]


def test_double_text(spark):
    values = [0.0, 1.0, 1.1, 100.0, 12345678.9, 1e7, 123456789012.5, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 0.00012, 1e-5, 1.25e-7, -2.5, -1e20, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(T.double_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_natural_types(spark):
    df = spark.sql("SELECT '2024-01-02' a, '2024-01-02 03:04:05' b, 'x' c, true d, X'0F' e, CAST(1.50 AS DECIMAL(5,2)) f, TIMESTAMP_NTZ'2024-01-02 03:04:05.5' g, DATE'2024-01-02' h, '2024-13-40' i")
    got = df.select(*(T.term_text(T.natural(F.col(c), k)).alias(c) for c, k in df.dtypes)).first()
    x = f"^^<{XSD}"
    assert list(got) == [f'"2024-01-02"{x}date>', f'"2024-01-02T03:04:05"{x}dateTime>', '"x"', f'"true"{x}boolean>', '"0F"', f'"1.50"{x}decimal>', f'"2024-01-02T03:04:05.500000"{x}dateTime>', f'"2024-01-02"{x}date>', '"2024-13-40"']


# Functions


def test_registry(spark):
    uri = EX + "twice"
    FunctionRegistry.register(uri, lambda s: s * 2)
    call = lambda v: FunctionRegistry.call(uri, [v]).lex
    assert texts(spark, ["ab", None], call) == ["abab", None]  # an exception is epsilon
    assert uri in FunctionRegistry.list_registered()
    FunctionRegistry.unregister(uri)
    assert texts(spark, ["ab"], call) == [None]
    assert FunctionRegistry.get("http://any.example/functions#concat") == FunctionRegistry.get(FUNCTIONS + "concat")


def test_media_types(spark):
    f = lambda v: FunctionRegistry.call("http://example.com/idlab/function/getMIMEType", [v]).lex
    assert texts(spark, ["a.TTL", "d.x/a.nq", ".csv", "a", None, "x.tar.json"], f) == ["text/turtle", "application/n-quads", "application/octet-stream", "application/octet-stream", "application/octet-stream", "application/json"]


# Operators


def frame(spark, rows, schema):
    return S.Frame(spark.createDataFrame(rows, schema), typed=False)


def test_project_extend_union(spark):
    src = Source(frame(spark, [("1", "a"), ("2", "b")], "id string, name string"), "$", (("id", "id"), ("name", "name")))
    out = src.extend("name", Constant(Literal("z"))).project("name").execute(spark).terms()
    assert [r.name.value for r in out.collect()] == ["z", "z"]
    with pytest.raises(KeyError):
        src.project("nothing")
    with pytest.raises(ValueError):
        Union(())
    assert Union((src, src)).execute(spark).df.count() == 4
    assert Union((src, src), True).execute(spark).df.count() == 2


def test_terms_for_rdflib(monkeypatch):
    import sys
    import types

    from kgspark.functions.terms import to_rdflib

    made = types.SimpleNamespace(URIRef=lambda v: ("uri", v), BNode=lambda v: ("bnode", v), Literal=lambda v, lang=None, datatype=None: ("literal", v, lang, datatype))
    monkeypatch.setitem(sys.modules, "rdflib", made)
    assert to_rdflib(None) is None and to_rdflib(7) == 7
    assert to_rdflib(IRI("http://e/a")) == ("uri", "http://e/a") and to_rdflib(BlankNode("b")) == ("bnode", "b")
    assert to_rdflib(Literal("x", lang="en")) == ("literal", "x", "en", None)
    assert to_rdflib(Literal("1", "http://e/d")) == ("literal", "1", None, ("uri", "http://e/d"))


def test_join(spark):
    left = Source(frame(spark, [("1", "a"), ("2", "b")], "id string, name string"), "$", (("id", "id"), ("name", "name")))
    right = Source(S.Frame(spark.createDataFrame([(1, "x"), (3, "y")], "ref int, dept string")), "$", (("ref", "ref"), ("dept", "dept")))
    assert [(r.name.value, r.dept.value) for r in EquiJoin(left, right, ("id",), ("ref",)).execute(spark).terms().collect()] == [("a", "x")]
    assert EquiJoin(left, right).execute(spark).df.count() == 4
    assert EquiJoin(left, right, ("ID",), ("parent_ref",)).left_attributes == ("id",)
    assert EquiJoin(left, right, A=["id"], B=["ref"]) == EquiJoin(left, right, ("id",), ("ref",))
    with pytest.raises(TypeError):
        EquiJoin(left, right, C=["id"])
    with pytest.raises(ValueError):
        EquiJoin(left, right, A=["id"])
    with pytest.raises(ValueError):
        EquiJoin(left, right, ("id",), ())
    with pytest.raises(KeyError):
        EquiJoin(left, right, ("nothing",), ("ref",))
    with pytest.raises(ValueError):
        EquiJoin(left, left, ("id",), ("name",))


def test_explain(spark):
    src = Source(frame(spark, [], "id string"), "$", (("id", "id"),))
    op = Project(Extend(src, "s", FunctionCall(FUNCTIONS + "toBNode", (Reference("id"),))), ("s",))
    text = op.explain()
    assert text.startswith("Project(\n  attributes: ['s']") and "Ref(id)" in text and "\\-- Source(" in text
    tree = json.loads(Union((op, op)).explain_json())
    assert tree["type"] == "Union" and len(tree["children"]) == 2
    assert tree["children"][0]["parent"]["parameters"]["expression"]["function"].endswith("toBNode")


# Sources


def read(spark, reader, iterator, **mappings):
    df, values = reader.read(spark, iterator, mappings)
    return sorted((tuple(r) for r in df.select(*(values[a].lex.alias(a) for a in mappings)).collect()), key=str)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json(spark, tmp_path):
    path = write(tmp_path / "a.json", '{"items": [{"id": 1, "name": "a", "tags": ["x", "y"]}, {"id": 2.50, "name": null, "tags": []}, {"id": 3, "o": {"p": true}}]}')
    src = S.JsonFile(path)
    assert read(spark, src, "$.items[*]", id="id") == [("1",), ("2.5",), ("3",)]
    assert read(spark, src, "$.items", id="$.id") == [("1",), ("2.5",), ("3",)]
    assert read(spark, src, "$.items[*]", id="id", name="name") == [("1", "a"), ("2.5", None)]
    assert read(spark, src, "$.items[*]", id="id", tag="tags") == [("1", "x"), ("1", "y")]
    assert read(spark, src, "$.items[*]", p="o.p") == [("true",)]
    assert read(spark, src, "$.items[*]", o="o") == [(None,)]
    assert read(spark, src, "$.items[1]", id="id") == [("2.5",)]
    assert read(spark, src, "$", id="items[*].id") == [("1",), ("2.5",), ("3",)]
    assert read(spark, src, "$.nothing[*]", id="id") == []
    assert read(spark, S.JsonFile(write(tmp_path / "b.json", '[{"n": "q\\"\\n"}]')), "$", n="n") == [('q"\n',)]
    lines = S.JsonFile(write(tmp_path / "c.ndjson", '{"a.b": 1}\n\n{"a.b": 2}\n'), lines=True)
    assert read(spark, lines, "$", v="$['a.b']") == [("1",), ("2",)]


def test_json_numbers(spark, tmp_path):
    values = [1, 1.0, 1.5, 100.0, 12345678.9, 1.5e10, 1e-5, 0.0001, -2.5e-7, 123456789]
    path = write(tmp_path / "n.json", json.dumps([{"v": v} for v in values]))
    assert sorted(read(spark, S.JsonFile(path), "$[*]", v="v")) == sorted((str(v),) for v in values)


def test_default_graph_only(spark):
    t = table(spark, id=[1, 1])
    text = PREFIX + 'ex:M rr:logicalTable [ rr:tableName "t" ] ; rr:subjectMap [ rr:template "http://e/{id}" ; rr:class ex:T %s ] .'
    for more, alone, n in (("", True, 1), ("; rr:graph ex:g", False, 1), ("; rr:graph rr:defaultGraph", True, 1), ("; rr:graph rr:defaultGraph, ex:g", False, 1)):
        result = Mapping(text % more, options=Options(frames={"t": t})).execute(spark)
        assert result.default_only is alone and sinks.nquads(result).count() == n


def test_json_paths():
    assert parse_path("$.a['b c'][0][*].d") == ["a", "b c", 0, None, "d"]
    for bad in ("$..", "$.a[?(@.b]", "$.a[1:2:0]", "$.a[?(@.b ==)]", "$.a[?]"):
        with pytest.raises(ValueError):
            parse_path(bad)


BOOKS = [
    {"id": 1, "price": 8, "kind": "a", "tags": ["x", "y", "z"], "sub": {"id": 11, "sub": {"id": 111}}},
    {"id": 2, "price": "9", "kind": "b", "tags": "single", "more": [{"id": 21}, [{"id": 22}]]},
    {"id": 3, "price": 12.5, "kind": None, "tags": [], "flag": True},
    {"id": 4, "kind": "a", "low": 3, "price": 2},
]


@pytest.mark.parametrize(
    "iterator, expected",
    [
        ("$.books[1:3]", ["2", "3"]),
        ("$.books[:2]", ["1", "2"]),
        ("$.books[-1]", ["4"]),
        ("$.books[-2:]", ["3", "4"]),
        ("$.books[::2]", ["1", "3"]),
        ("$.books[::-1]", ["1", "2", "3", "4"]),
        ("$.books[3:0:-2]", ["2", "4"]),
        ("$.books[9:]", []),
        ("$.books[?(@.price < 10)]", ["1", "4"]),
        ("$.books[?(@.price == '9')]", ["2"]),
        ("$.books[?(@.kind == 'a' && !(@.price > 5))]", ["4"]),
        ("$.books[?@.flag == true || @.kind == null]", ["3"]),
        ("$.books[?(@.low)]", ["4"]),
        ("$.books[?(@.low > @.price)].sub", []),
        ("$.books[?(@.price != 8)]", ["2", "3", "4"]),
        ("$.books[?(@.sub.id == 11)].sub", ["11"]),
        ("$['books','none'][0]", ["1"]),
        ("$..sub", ["11", "111"]),
        ("$..books[0]", ["1"]),
        ("$.one[*]", ["7"]),
        ("$.one.*", []),
        ("$.deep.*", ["5", "6"]),
    ],
)
def test_json_path_steps(spark, tmp_path, iterator, expected):
    path = write(tmp_path / "a.json", json.dumps({"books": BOOKS, "one": {"id": 7}, "deep": {"p": {"id": 5}, "q": {"id": 6}}}))
    assert sorted(r[0] for r in read(spark, S.JsonFile(path), iterator, id="id")) == sorted(expected)


def test_json_path_values(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps({"books": BOOKS}))
    src = S.JsonFile(path)
    assert read(spark, src, "$.books[0]", t="tags[1:]") == [("y",), ("z",)]
    assert read(spark, src, "$.books[0]", t="tags[?(@ == 'y')]") == [("y",)]
    assert read(spark, src, "$.books[1]", t="tags[*]") == [("single",)]
    assert sorted(read(spark, src, "$", i="$..id")) == sorted((str(i),) for i in (1, 2, 3, 4, 11, 111, 21, 22))
    deep = "7"
    for _ in range(60):
        deep = '{"n": [' + deep + "]}"
    assert read(spark, S.JsonFile(write(tmp_path / "d.json", '{"v": ' + deep + "}")), "$.v" + ".n[0]" * 60, v="$") == [("7",)]
    assert len(read(spark, S.JsonFile(str(tmp_path / "d.json")), "$..n", v="$..n")) > 0


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'ID,Name,x.y\n1,"a ""q"", b",p\n2,,\n3\n4,d,e,f\n')
    src = S.CsvFile(path)
    assert read(spark, src, "$", i="id", n="$.Name") == [("1", 'a "q", b'), ("2", ""), ("4", "d")]
    assert read(spark, src, "$", i="$['ID']") == [("1",), ("2",), ("3",), ("4",)]
    assert read(spark, src, "$", v="x.y") == [("",), ("e",), ("p",)]


def test_xml(spark, tmp_path):
    path = write(tmp_path / "a.xml", '<root><row code="01"><name>A</name><in><v>1</v><v>2</v></in></row><row code="2"><name/></row></root>')
    src = S.XmlFile(path)
    assert read(spark, src, "/root/row", c="@code") == [("01",), ("2",)]
    assert read(spark, src, ".//row", c="@code", n="name") == [("01", "A")]
    assert read(spark, src, "row", v="in/v") == [("1",), ("2",)]
    assert read(spark, src, "row", v="nothing") == []


def test_xml_paths(spark, tmp_path):
    path = write(tmp_path / "b.xml", '<root><a k="1"><row n="1"/><row n="2"/></a><b><row n="3"><sub><row n="4"/></sub></row></b><row n="5"/></root>')
    src = S.XmlFile(path)
    got = lambda iterator: [x[0] for x in read(spark, src, iterator, n="@n")]
    assert got("/root/a/row") == ["1", "2"] and got("/root/b/row") == ["3"] and got("a/row") == ["1", "2"]
    assert got("/root/row") == got("row") == ["5"]
    assert got("a/row[2]") == ["2"] and got("*/row[@n='3']") == ["3"] and got(".//sub/row") == ["4"] and got("/sub/row") == ["4"]
    assert got("/elsewhere/row") == ["1", "2", "3", "4", "5"]  # its last step alone names the rows
    assert read(spark, src, "/root/b", n="row/sub/row/@n") == [("4",)] and read(spark, src, ".", n="a/@k") == [("1",)]
    assert got("nothing") == []
    with pytest.raises(ValueError):
        got("row[position()<2]")


def test_relative_references(spark):
    from urllib.parse import urljoin

    references = ["x", "../x", "../../x", "../../../x/y", "a/../b", "a/./b", "./x", ".", "..", "../", "/a/../b", "/..", "a/..", "a/.", "x?q=/../y", "../x?q#f", "#f", "?q", "", "a..b/c", ".hidden", "a/b/../../c/"]
    for base in ("http://h.org/one/two/three", "http://h.org/one/", "http://h.org/"):
        df = spark.createDataFrame([(r,) for r in references], "r string")
        got = {r.r: r.j for r in df.select("r", T._joined(base, F.col("r")).alias("j")).collect()}
        assert got == {r: urljoin(base, r) for r in references}


def test_sql_script(spark, tmp_path):
    write(tmp_path / "resource1.sql", "USE x;\nCREATE TABLE demo (flag BIT, code CHAR(3), created DATETIME, n INTEGER, payload VARBINARY(2));\nINSERT INTO demo VALUES (1, 'A', '2024-01-02 03:04:05', 7, 0x0F);\n")
    df, values = S.ScriptTables(str(tmp_path), "demo").read(spark, "$", {c: c for c in ("flag", "code", "created", "n", "payload")})
    row = df.select(*(T.term_text(v).alias(a) for a, v in values.items())).first()
    assert list(row) == [f'"true"^^<{XSD}boolean>', '"A  "', f'"2024-01-02T03:04:05"^^<{XSD}dateTime>', f'"7"^^<{XSD}integer>', '"0F"']
    assert S.ScriptTables(str(tmp_path), "none").read(spark, "$", {"a": "a"})[0].count() == 0
    with pytest.raises(ValueError):
        S.ScriptTables(str(tmp_path), "Demo", strict_names=True).read(spark, "$", {"a": "a"})


def test_sql_helpers():
    assert jdbc_url("mysql://u:p@h:1/d") == "jdbc:mysql://h:1/d"
    assert jdbc_url("postgres://h/d") == "jdbc:postgresql://h/d"
    assert jdbc_url("DRIVER={ODBC};SERVER=h,1433;DATABASE=d") == "jdbc:sqlserver://h:1433;databaseName=d"
    with pytest.raises(ValueError):
        jdbc_url("what")
    assert [database_kind("com.mysql.jdbc.Driver", None), database_kind(None, "jdbc:postgresql://h"), database_kind("mssql", ""), database_kind(None, None)] == ["mysql", "postgresql", "sqlserver", None]
    assert portable("VALUES (CAST('0fA1' AS VARBINARY(2)), cast ( '00' as varbinary ))") == "VALUES (X'0fA1', X'00')"
    assert "X'0F'" in portable("VALUES (0x0F)") and "CASCADE" not in portable("DROP TABLE a CASCADE")
    assert script_types("CREATE TABLE t (a INT, b CHAR(3), PRIMARY KEY (a));") == {"a": "INT", "b": "CHAR(3)"}


def test_strict(spark, tmp_path):
    src = S.JsonFile(write(tmp_path / "a.json", '[{"a": 1}]'))
    with pytest.raises(MissingReference):
        src.read(spark, "$[*]", {"b": "b"}, True)
    src.read(spark, "$[*]", {"a": "a"}, True)
    with pytest.raises(KeyError):
        S.Frame(spark.createDataFrame([(1,)], "a int")).read(spark, "$", {"b": "b"}, True)


# Turtle


def test_turtle():
    triples = turtle.parse('@prefix e: <http://e/> . @base <http://b/> . e:a a e:C ; e:p "x"@en, 1, 1.5, 2e0, true, """l\n"q" """, "d"^^e:t . <r> e:q [ e:z ( 1 2 ) ] . # end')
    objects = [o for s, p, o in triples if p == IRI("http://e/p")]
    assert objects == [Literal("x", lang="en"), Literal("1", XSD + "integer"), Literal("1.5", XSD + "decimal"), Literal("2e0", XSD + "double"), Literal("true", XSD + "boolean"), Literal('l\n"q" '), Literal("d", "http://e/t")]
    assert (IRI("http://b/r"), IRI("http://e/q"), BlankNode("g1")) in triples
    assert len(triples) == 14
    for bad in ("e:a e:b e:c .", "<a> <b> .", "<a> <b> <c>", "!"):
        with pytest.raises(ValueError):
            turtle.parse(bad)
    assert turtle.base_of("@base <http://x/> .") == "http://x/"


def test_templates():
    assert template_parts("a{b}c{d.e}") == [("text", "a"), ("var", "b"), ("text", "c"), ("var", "d.e")]
    assert template_parts("{{x}}{y") == [("text", "{{x}}{y")]
    assert template_parts("\\{a\\}") == [("var", "a")]


# Mappings


def quads(spark, text, base=None, **options):
    df = Mapping(PREFIX + text, options=Options(**options), base=base).execute(spark).text()
    return sorted(tuple(r) for r in df.fillna("").collect())


def table(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), names)


def test_mapping_rules(spark):
    t = table(spark, id=[1, 2], name=["a b", "c"])
    frames = {"t": t}
    m = 'ex:M rr:logicalTable [ rr:tableName "t" ] ; %s rr:subjectMap [ rr:template "http://e/{id}" ] .'
    got = quads(spark, m % 'rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:template "http://e/n/{name}" ] ] ;', frames=frames)
    assert [q[2] for q in got] == ["<http://e/n/a%20b>", "<http://e/n/c>"]
    assert quads(spark, m % 'rr:predicateObjectMap [ rr:predicate ex:p ; rr:object "" ] ;', frames=frames)[0][2] == '""'
    with pytest.raises(MappingError):
        quads(spark, m % "rr:predicateObjectMap [ rr:predicate ex:p ] ;", frames=frames)
    with pytest.raises(MappingError):
        quads(spark, m % "rr:subject ex:x ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:object 1 ] ;", frames=frames)
    with pytest.raises(MappingError):
        quads(spark, m % 'rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rml:reference "name" ; rr:language "en" ; rr:datatype xsd:string ] ] ;', frames=frames)
    with pytest.raises(MappingError):
        quads(spark, m % 'rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rml:reference "name" ; rr:language "english language" ] ] ;', frames=frames)
    with pytest.raises(MappingError):
        quads(spark, m.replace("rr:template", "rr:termType rr:Literal ; rr:template") % 'rr:predicateObjectMap [ rr:predicate ex:p ; rr:object 1 ] ;', frames=frames)
    assert quads(spark, m % 'rr:predicateObjectMap [ rr:predicate ex:p ; rr:object 5 ; rr:graph rr:defaultGraph ] ;', frames=frames)[0][2:] == (f'"5"^^<{XSD}integer>', "")


def test_missing_values_are_local_to_a_branch(spark):
    """One map's missing reference does not take another map's triples, with a shared scan too."""
    t = spark.createDataFrame([(1, "a", None), (2, None, "z")], "id int, x string, y string")
    m = 'ex:M rr:logicalTable [ rr:tableName "t" ] ; rr:predicateObjectMap [ rr:predicate ex:x ; rr:objectMap [ rml:reference "x" ] ] ; rr:predicateObjectMap [ rr:predicate ex:y ; rr:objectMap [ rml:reference "y" ] ] ; rr:subjectMap [ rr:template "http://e/{id}" ] .'
    assert [(q[0], q[2]) for q in quads(spark, m, frames={"t": t})] == [("<http://e/1>", '"a"'), ("<http://e/2>", '"z"')]


def test_two_issue_sources(spark, tmp_path):
    """Two JSON sources of different shape, one graph."""
    write(tmp_path / "a.json", '[{"number": 1, "title": "T", "user": {"login": "ann"}, "created_at": "2024-01-01T00:00:00Z"}, {"number": 2, "title": null, "user": {"login": "bo"}}]')
    write(tmp_path / "b.json", '[{"iid": 9, "title": "U", "author": {"username": "cy"}}]')
    part = '<#%s> rml:logicalSource [ rml:source "%s" ; rml:referenceFormulation ql:JSONPath ; rml:iterator "$[*]" ] ; rr:subjectMap [ rr:template "http://%s/issue/{%s}" ; rr:class ex:Issue ] ; rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rml:reference "title" ] ] ; rr:predicateObjectMap [ rr:predicate ex:creator ; rr:objectMap [ rml:reference "%s" ] ] ; rr:predicateObjectMap [ rr:predicate ex:source ; rr:object "%s" ] .\n'
    text = PREFIX + part % ("A", "a.json", "a", "number", "user.login", "A") + part % ("B", "b.json", "b", "iid", "author.username", "B")
    got = {tuple(r)[:3] for r in Mapping(text, str(tmp_path)).execute(spark).text().collect()}
    assert ("<http://a/issue/1>", f"<{EX}name>", '"T"') in got and ("<http://b/issue/9>", f"<{EX}creator>", '"cy"') in got
    assert len(got) == 3 + 3 + 2 + 3


def test_documents_are_read_once(spark, tmp_path):
    """Many branches over one document: one scan, with the rows that a scan for each would give."""
    write(tmp_path / "a.json", '[{"id": 1, "n": "x", "tags": ["a", "b"], "more": [1, 2]}, {"id": 2, "tags": []}, {"n": "y"}, {"id": "4 4", "n": null, "more": [3]}]')
    write(tmp_path / "a.xml", '<r><e id="1"><n>x</n><t>a</t><t>b</t></e><e id="2"><t>c</t></e></r>')
    poms = 'rr:predicateObjectMap [ rr:predicate ex:n, ex:m ; rr:objectMap [ rml:reference "n" ] ] ; rr:predicateObjectMap [ rr:predicate ex:t ; rr:objectMap [ rr:template "http://t/{%s}/{%s}" ] ] ; rr:predicateObjectMap [ rr:predicate ex:i ; rr:objectMap [ rml:reference "%s" ; rr:datatype xsd:integer ] ; rr:graphMap [ rr:template "http://g/{%s}" ] ] ;'
    text = 'ex:M rml:logicalSource [ rml:source "%s" ; rml:referenceFormulation ql:%s ; rml:iterator "%s" ] ; ' + poms + ' rr:subjectMap [ rr:template "http://e/{%s}" ; rr:class ex:E ] .'
    for args in (("a.json", "JSONPath", "$[*]", "tags", "more", "id", "id", "id"), ("a.xml", "XPath", "/r/e", "t", "n", "@id", "t", "@id")):
        plan = Mapping(PREFIX + text % args, str(tmp_path)).plan()
        df = plan.execute(spark).text()
        alone = [tuple(r) for part in plan.parts for r in part.execute(spark).text().collect()]
        assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(alone, key=str) and len(alone) > 8
        assert df._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
        terms = plan.execute(spark).terms()
        assert terms.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL").count() == len(alone)


def test_nested_functions_and_order(spark):
    t = table(spark, a=["x"], b=["y"])
    call = "fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object fn:concat ] ; rr:predicateObjectMap [ rr:predicate ex:p10 ; rr:objectMap [ rr:constant \"!\" ] ] ; rr:predicateObjectMap [ rr:predicate ex:p2 ; rr:objectMap [ %s ] ] ; rr:predicateObjectMap [ rr:predicate ex:p1 ; rr:objectMap [ rml:reference \"a\" ] ] ]"
    inner = call % 'rml:reference "b"'
    m = f'ex:M rr:logicalTable [ rr:tableName "t" ] ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ {call % inner} ] ] ; rr:subjectMap [ rr:template "http://e/{{a}}" ] .'
    assert quads(spark, m, frames={"t": t})[0][2] == '"xxy!!"'


def test_join_variants(spark):
    frames = {"c": table(spark, id=[1, 2], ref=["10", "20"]), "p": table(spark, id=[10, 20], other=["u", None])}
    text = 'ex:P rr:logicalTable [ rr:tableName "p" ] ; rr:subjectMap [ rr:template "http://p/{id}" ] ; rr:predicateObjectMap [ rr:predicate ex:o ; rr:objectMap [ rml:reference "other" ] ] . ex:C rr:logicalTable [ rr:tableName "c" ] ; rr:subjectMap [ rr:template "http://c/{id}" ] ; rr:predicateObjectMap [ rr:predicate ex:r ; rr:objectMap [ rr:parentTriplesMap ex:P %s ] ] .'
    joined = [q for q in quads(spark, text % '; rr:joinCondition [ rr:child "ref" ; rr:parent "id" ]', frames=frames) if q[1] == f"<{EX}r>"]
    assert [(q[0], q[2]) for q in joined] == [("<http://c/1>", "<http://p/10>"), ("<http://c/2>", "<http://p/20>")]
    assert len([q for q in quads(spark, text % "", frames=frames) if q[1] == f"<{EX}r>"]) == 4


def test_errors_can_be_skipped(spark):
    t = table(spark, id=[1])
    text = 'ex:A rml:logicalSource [ rml:source "none.json" ] ; rr:subject ex:a ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:object 1 ] . ex:B rr:logicalTable [ rr:tableName "t" ] ; rr:subjectMap [ rr:template "http://e/{id}" ; rr:class ex:T ] .'
    with pytest.raises(FileNotFoundError):
        quads(spark, text, frames={"t": t})
    assert len(quads(spark, text, frames={"t": t}, on_error="skip")) == 1


# Sinks


def test_finalised(spark):
    df = spark.createDataFrame([("s", "p", "o", None), ("s", "p", "o", "g"), ("s", "p", "o", "h"), ("s", "p", "x", None), ("s", "p", "x", None)], "subject string, predicate string, object string, graph string")
    assert sorted(r.line for r in sinks.nquads(df).collect()) == ["s p o g .", "s p o h .", "s p x ."]
    assert sorted(r.line for r in sinks.ntriples(df).collect()) == ["s p o .", "s p x ."]


def test_write(spark, tmp_path):
    df = spark.createDataFrame([("<s>", "<p>", "<o>", "<g>")], "subject string, predicate string, object string, graph string")
    sinks.write(df, str(tmp_path / "a.nq"), single_file=True)
    assert (tmp_path / "a.nq").read_text() == "<s> <p> <o> <g> .\n"
    sinks.write(df, str(tmp_path / "b.ttl"), single_file=True)
    assert (tmp_path / "b.ttl").read_text() == "<s> <p> <o> .\n"
    sinks.write(df, str(tmp_path / "c.parquet"))
    assert spark.read.parquet(str(tmp_path / "c.parquet")).count() == 1
    sinks.write(df, str(tmp_path / "d.nt"))
    assert spark.read.text(str(tmp_path / "d.nt")).count() == 1


# SPARQL


@pytest.fixture(scope="module")
def graph(spark):
    return graph_frame(spark, '@prefix e: <http://e/> . e:a e:n "A" ; e:k 1 ; e:f e:b . e:b e:n "B"@en ; e:k 20 . e:c e:k 3 . e:d e:g e:e . e:e e:g e:f . e:f e:g e:d, e:g .')


@pytest.mark.parametrize(
    "query, rows",
    [
        ("SELECT ?n WHERE { e:a e:n ?n }", [('"A"',)]),
        ("SELECT ?x ?n WHERE { ?x e:k ?k . OPTIONAL { ?x e:n ?n } FILTER(?k < 5) }", [("<http://e/a>", '"A"'), ("<http://e/c>", None)]),
        ("SELECT ?x WHERE { { ?x e:n \"A\" } UNION { ?x e:k 3 } }", [("<http://e/a>",), ("<http://e/c>",)]),
        ("SELECT ?n WHERE { VALUES ?x { e:b e:c } ?x e:n ?n }", [('"B"@en',)]),
        ("SELECT ?u WHERE { ?x e:n ?n BIND(UCASE(CONCAT(STR(?n), \"-z\")) AS ?u) FILTER(LANG(?n) = \"en\") }", [('"B-Z"',)]),
        ("SELECT DISTINCT ?p WHERE { ?x ?p ?o } ORDER BY DESC(?p) LIMIT 1", [("<http://e/n>",)]),
        ("SELECT ?x WHERE { ?x e:f/e:n ?n }", [("<http://e/a>",)]),
        ("SELECT ?x WHERE { ?x ^e:f/e:k 1 }", [("<http://e/b>",)]),
        ("SELECT ?x ?v WHERE { ?x e:n|e:k ?v FILTER(?x = e:a) }", [("<http://e/a>", '"1"^^<INT>'), ("<http://e/a>", '"A"')]),
        ("SELECT ?v WHERE { e:c !e:n ?v }", [('"3"^^<INT>',)]),
        ("SELECT ?v WHERE { e:a !(e:k|e:n) ?v }", [("<http://e/b>",)]),
        ("SELECT ?v WHERE { e:a e:f? ?v }", [("<http://e/a>",), ("<http://e/b>",)]),
        ("SELECT ?v WHERE { e:d (e:g/e:g)* ?v }", [("<http://e/d>",), ("<http://e/e>",), ("<http://e/f>",), ("<http://e/g>",)]),
        ("SELECT ?v WHERE { e:d e:g+ ?v }", [("<http://e/d>",), ("<http://e/e>",), ("<http://e/f>",), ("<http://e/g>",)]),
        ("SELECT ?v WHERE { ?v e:g+ e:g }", [("<http://e/d>",), ("<http://e/e>",), ("<http://e/f>",)]),
        ("SELECT (COUNT(*) AS ?n) WHERE { ?x e:g+ ?y }", [('"12"^^<INT>',)]),
        ("SELECT ?x WHERE { ?x e:g+ ?x }", [("<http://e/d>",), ("<http://e/e>",), ("<http://e/f>",)]),
        ("SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x e:f* ?x }", [('"12"^^<INT>',)]),
        ("SELECT ?p (COUNT(?x) AS ?n) WHERE { ?x ?p ?y FILTER(?p IN (e:k, e:n)) } GROUP BY ?p", [("<http://e/k>", '"3"^^<INT>'), ("<http://e/n>", '"2"^^<INT>')]),
        ("SELECT (SUM(?k) AS ?s) (AVG(?k) AS ?m) (MIN(?k) AS ?a) (MAX(?k) AS ?z) WHERE { ?x e:k ?k }", [('"24"^^<INT>', '"8"^^<DEC>', '"1"^^<INT>', '"20"^^<INT>')]),
        ("SELECT (SUM(?n) AS ?s) (COUNT(?n) AS ?c) WHERE { ?x e:n ?n }", [(None, '"2"^^<INT>')]),
        ("SELECT (SUM(?n) AS ?s) (AVG(?n) AS ?a) (COUNT(*) AS ?c) WHERE { ?x e:none ?n }", [('"0"^^<INT>', '"0"^^<INT>', '"0"^^<INT>')]),
        ("SELECT ?p WHERE { ?x ?p ?y } GROUP BY ?p HAVING (COUNT(*) > 2 && COUNT(*) < 4)", [("<http://e/k>",)]),
        ("SELECT (GROUP_CONCAT(?n; SEPARATOR=\"; \") AS ?all) WHERE { ?x e:n ?n }", [('"A; B"',)]),
        ("SELECT ?b (COUNT(*) AS ?c) WHERE { ?x e:k ?k } GROUP BY (?k > 2 AS ?b)", [('"false"^^<BOOL>', '"1"^^<INT>'), ('"true"^^<BOOL>', '"2"^^<INT>')]),
        ("SELECT ?x ?p WHERE { ?x ?p 1 } GROUP BY ?x", None),
        ("SELECT ?x (?k * 2 + 1 AS ?y) WHERE { ?x e:k ?k FILTER(?k / 2 = 0.5 || -?k = -3) }", [("<http://e/a>", '"3"^^<INT>'), ("<http://e/c>", '"7"^^<INT>')]),
        ("SELECT ?k WHERE { ?x e:k ?k } ORDER BY DESC(?k) LIMIT 1", [('"20"^^<INT>',)]),
        ("SELECT ?x WHERE { ?x e:k ?k } ORDER BY ?k OFFSET 2", [("<http://e/b>",)]),
        ("SELECT ?x WHERE { ?x e:k ?k MINUS { ?x e:n ?n } }", [("<http://e/c>",)]),
        ("SELECT ?x WHERE { ?x e:k ?k MINUS { ?y e:n ?n } }", [("<http://e/a>",), ("<http://e/b>",), ("<http://e/c>",)]),
        ("SELECT ?x WHERE { ?x e:k ?k FILTER EXISTS { ?x e:n ?n } }", [("<http://e/a>",), ("<http://e/b>",)]),
        ("SELECT ?x WHERE { ?x e:k ?k FILTER NOT EXISTS { ?y e:k ?m FILTER(?m > ?k) } }", [("<http://e/b>",)]),
        ("SELECT ?x WHERE { ?x e:k ?k FILTER NOT EXISTS { ?y e:none ?m } FILTER(?k NOT IN (1, 3)) }", [("<http://e/b>",)]),
        ("SELECT ?x ?m WHERE { ?x e:k ?m { SELECT (MAX(?k) AS ?m) WHERE { ?y e:k ?k } } }", [("<http://e/b>", '"20"^^<INT>')]),
        ("SELECT ?x ?n WHERE { VALUES (?x ?n) { (e:a UNDEF) (e:b \"B\"@en) (e:c \"C\") } ?x e:n ?n }", [("<http://e/a>", '"A"'), ("<http://e/b>", '"B"@en')]),
        ("SELECT ?x ?n WHERE { ?x e:k ?k OPTIONAL { ?x e:none ?n } OPTIONAL { ?x e:n ?n } }", [("<http://e/a>", '"A"'), ("<http://e/b>", '"B"@en'), ("<http://e/c>", None)]),
        ("SELECT (IF(?k > 2, STRLEN(\"abc\"), DATATYPE(?k)) AS ?r) WHERE { e:a e:k ?k }", [("<INT>",)]),
        ("SELECT (SUBSTR(\"abcd\", 2, 2) AS ?r) (STRAFTER(\"a=b\", \"=\") AS ?t) (<http://www.w3.org/2001/XMLSchema#integer>(\"7\") + 1 AS ?u) WHERE { }", [('"bc"', '"b"', '"8"^^<INT>')]),
        ("SELECT ?x ?x WHERE { ?x ?p ?o }", None),
        ("", None),
        ("SELECT ?x ?y WHERE { ?x e:k ?k OPTIONAL { ?y e:k ?m FILTER(?m > ?k && ?m < 10) } }", [("<http://e/a>", "<http://e/c>"), ("<http://e/b>", None), ("<http://e/c>", None)]),
        ("SELECT ?x WHERE { ?x e:k ?k FILTER(?k = 3.0) }", [("<http://e/c>",)]),
        ('SELECT ?a WHERE { VALUES (?a ?b) { ("3" "3.0") ("x" "x") } FILTER(?a = ?b) }', [('"x"',)]),
        ("SELECT ?x WHERE { ?x e:n ?n FILTER(REGEX(STR(?n), \"^a$\", \"i\") || !BOUND(?n)) }", [("<http://e/a>",)]),
    ],
)
def test_select(graph, query, rows):
    text = "PREFIX e: <http://e/> " + query if query else query
    if rows is None:
        with pytest.raises(SparqlError):
            select(graph, text)
    else:
        short = {"INT": "integer", "DEC": "decimal", "BOOL": "boolean"}
        rows = [tuple(v and re.sub("<(INT|DEC|BOOL)>", lambda m: f"<http://www.w3.org/2001/XMLSchema#{short[m[1]]}>", v) for v in r) for r in rows]
        assert sorted((tuple(r) for r in select(graph, text).collect()), key=str) == sorted(rows, key=str)


def test_select_in_graphs(spark):
    quads = spark.createDataFrame([("<a>", "<p>", "<b>", "<g>"), ("<b>", "<p>", "<c>", "<h>"), ("<a>", "<p>", "<b>", "<h>"), ("<x>", "<p>", "<y>", None), ("<a>", "<p>", "<b>", "<g>")], "subject string, predicate string, object string, graph string")

    def got(text):
        return sorted(tuple(r) for r in select(quads, text).collect())

    assert got("SELECT ?g ?t WHERE { GRAPH ?g { <a> <p>+ ?t } }") == [("<g>", "<b>"), ("<h>", "<b>"), ("<h>", "<c>")]
    assert got("SELECT ?t WHERE { GRAPH <g> { <a> <p>* ?t } }") == [("<a>",), ("<b>",)]
    assert got("SELECT ?t WHERE { <a> <p>+ ?t }") == [("<b>",), ("<c>",)]
    assert got("SELECT DISTINCT ?s WHERE { ?s <p> ?t }") == [("<a>",), ("<b>",), ("<x>",)]
    assert [r[0][1] for r in got("SELECT (COUNT(*) AS ?n) WHERE { ?s <p> ?t }")] == ["3"]  # triples, in whatever graphs


def test_mappings_are_found_in_order(tmp_path):
    from kgspark.sparql import mapping_for

    (tmp_path / "r1").mkdir()
    expected = [tmp_path / "r1" / "m.ttl", tmp_path / "r1_m.ttl", tmp_path / "m.ttl"]
    with pytest.raises(FileNotFoundError):
        mapping_for("r1", "m.ttl", str(tmp_path))
    for path in expected:
        path.write_text("")
        assert mapping_for("r1", "m.ttl", str(tmp_path)) == str(path)


def test_service_call_parts():
    q = 'SELECT * WHERE { VALUES ?r { <http://x/r1> "r2" r3 } BIND SERVICE-CALL(?r, "m.ttl") AS ?g GRAPH ?g { ?s ?p ?o } }'
    assert service_calls(q) == [("r", "m.ttl", "g")]
    assert values_of(q, "r") == ["<http://x/r1>", '"r2"', "r3"]
    assert [token_name(t) for t in values_of(q, "r")] == ["r1", "r2", "r3"]
    assert graph_iri("<http://x/r1>") == "http://x/r1"
    assert parse_select("SELECT * WHERE { ?s ?p ?o }").variables() == ["s", "p", "o"]


# Streams


def test_stream(spark, tmp_path):
    from kgspark.streaming import stream_quads

    folder = str(tmp_path / "in")
    spark.sql("SELECT id, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, 'click' AS kind FROM range(6)").union(spark.sql("SELECT 0L, TIMESTAMP'2024-01-01 00:00:00', 'click'")).write.parquet(folder)
    stream = spark.readStream.schema("id long, ts timestamp, kind string").parquet(folder)
    text = PREFIX + 'ex:M rr:logicalTable [ rr:tableName "events" ] ; rr:predicateObjectMap [ rr:predicate ex:kind ; rr:objectMap [ rml:reference "kind" ] ] ; rr:subjectMap [ rr:template "http://e/{id}" ; rr:class ex:Event ] .'
    for name, watermark, expected in (("plain", None, 14), ("once", ("ts", "1 minute"), 12)):
        q = stream_quads(spark, text, {"events": stream}, watermark).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == expected


# Commands


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from kgspark.commands import discovered, fetch, main

    assert {"run", "list-issues", "list-articles"} <= set(discovered())
    write(tmp_path / "a.json", '[{"number": 1}]')
    mapping = write(tmp_path / "m.ttl", PREFIX + f'ex:M rml:logicalSource [ rml:source "{{{{GITHUB_SOURCE}}}}" ; rml:iterator "$[*]" ] ; rr:subjectMap [ rr:template "http://e/{{number}}" ; rr:class ex:T ] .')
    monkeypatch.setattr(fetch, "get_json", lambda url, *a: [{"number": 7}] if "github" in url else 1 / 0)
    assert main(["list-issues", "https://github.com/o/r", "-m", mapping, "-o", str(tmp_path / "out.nt")]) == 0
    assert (tmp_path / "out.nt").read_text() == f"<http://e/7> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{EX}T> .\n"
    assert main(["run", "-m", mapping.replace("m.ttl", "none.ttl")]) == 1
    good = write(tmp_path / "n.ttl", (tmp_path / "m.ttl").read_text().replace("{{GITHUB_SOURCE}}", "a.json"))
    assert main(["run", "-m", good, "--explain"]) == 0 and "Source(" in capsys.readouterr().out
    assert main(["run", "-m", good]) == 0 and "<http://e/1>" in capsys.readouterr().out
    assert fetch.issues_url("https://github.com/o/r.git") == "https://api.github.com/repos/o/r/issues?state=all"
    assert fetch.issues_url("https://gitlab.com/g/p/") == "https://gitlab.com/api/v4/projects/g%2Fp/issues"
    data = {"result": {"hits": {"hit": [{"info": {"year": "2001"}}, {"info": {"year": "x"}}, {"info": {"year": "2020"}}]}}}
    assert len(fetch.filtered(data, "dblp", 2010, None)["result"]["hits"]["hit"]) == 2
    assert not os.path.exists(str(tmp_path / "data"))


def test_articles_are_asked_for_in_several_ways(tmp_path, monkeypatch):
    from kgspark.commands import fetch

    asked = []

    def answer(url, params):
        asked.append(params)
        if "openalex" in url:
            return {"results": [{"publication_year": 2020}]} if params.get("search") == "Ann" else {"results": []} if "search" in params else 1 / 0
        if "archives" in url:
            return {"response": {"numFound": 3, "docs": [{"producedDateY_i": 2020}] if params["rows"] == 500 else []}}
        raise OSError("down")

    monkeypatch.setattr(fetch, "get_json", answer)
    assert fetch.records(fetch.fetched("openalex", "Ann", 2019, 2021), "openalex") == [{"publication_year": 2020}]
    assert len(asked) == 3 and asked[0]["filter"] == "from_publication_date:2019-01-01,to_publication_date:2021-12-31"
    assert len(fetch.records(fetch.fetched("hal", "Ann", None, None), "hal")) == 1
    assert fetch.fetched("dblp", "Ann", None, None) is None
    monkeypatch.delenv("SERPAPI_API_KEY", raising=False)
    monkeypatch.delenv("SERPAPI_KEY", raising=False)
    asked.clear()
    assert fetch.fetched("serpapi", "Ann", None, None) is None and not asked
    monkeypatch.setenv("SERPAPI_KEY", "k")
    assert fetch.fetched("serpapi", "Ann", None, None) is None and asked[0]["api_key"] == "k"
