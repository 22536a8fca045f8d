"""The catalogue of queries, each with the SQL that gives the same rows.

Rows are subject, predicate, object and graph as N-Triples text, if nothing else is said.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import sinks
from kgspark import sources as S
from kgspark.functions.registry import BASES, CONDITIONS, FUNCTIONS, FunctionRegistry
from kgspark.functions.terms import IRI, RDF, XSD, Literal
from kgspark.plans.algebra import Constant, EquiJoin, Extend, FunctionCall, Project, Reference, Source, Union
from kgspark.plans.mapping import Mapping, Options
from kgspark.sparql import select, service_call

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EX = "http://example.org/"
PREFIX = f"""@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix fnml: <http://semweb.mmlab.be/ns/fnml#> .
@prefix fno: <https://w3id.org/function/ontology#> .
@prefix xsd: <{XSD}> .
@prefix fn: <{FUNCTIONS}> .
@prefix cond: <{CONDITIONS}> .
@prefix ex: <{EX}> .
"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def mapped(spark: SparkSession, sf_dir: str, text: str, base: str | None = None, **options) -> DataFrame:
    return Mapping(PREFIX + text, options=Options(folder=sf_dir, tables=TABLES, **options), base=base).execute(spark).text()


def pom(predicate: str, obj: str, more: str = "") -> str:
    return f"rr:predicateObjectMap [ rr:predicate {predicate} ; {obj} {more} ] ;"


def triples_map(name: str, table: str, subject: str, *poms: str) -> str:
    logical = f'rr:tableName "{table}"' if " " not in table else f'rr:sqlQuery """{table}"""'
    return f"ex:{name} rr:logicalTable [ {logical} ] ; {' '.join(poms)} rr:subjectMap [ {subject} ] ."


def reference(name: str, more: str = "") -> str:
    return f'rr:objectMap [ rml:reference "{name}" {more} ]'


def template(text: str, more: str = "") -> str:
    return f'rr:objectMap [ rr:template "{text}" {more} ]'


def function(uri: str, *args: str) -> str:
    params = " ; ".join(f"rr:predicateObjectMap [ rr:predicate ex:p{i + 1} ; rr:objectMap [ {a} ] ]" for i, a in enumerate(args))
    return f"rr:objectMap [ fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object {uri} ] {' ; ' + params if params else ''} ] ]"


# SQL for the oracle.


def iri(text: str) -> str:
    """text: SQL of the IRI."""
    return f"'<' || {text} || '>'"


def rows(table: str, subject: str, predicate: str, obj: str, graph: str = "CAST(NULL AS VARCHAR)", where: str = "TRUE") -> str:
    return f"SELECT {subject} AS subject, '<{predicate}>' AS predicate, {obj} AS object, {graph} AS graph FROM {table} WHERE {where}"


def typed(text: str, kind: str) -> str:
    return f"""'"' || {text} || '"^^<{XSD}{kind}>'"""


def plain(text: str) -> str:
    return f"""'"' || replace(replace(replace(replace(replace({text}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"'"""


def ex(path: str, *keys: str) -> str:
    return "'<" + EX + path + "/' || " + " || '/' || ".join(keys) + " || '>'"


TYPE = RDF + "type"
NATION = ex("nation", "n_nationkey")

# Sources


@query(rows("nation", NATION, EX + "name", plain("n_name")))
def source_table(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "nation", f'rr:template "{EX}nation/{{n_nationkey}}"', pom("ex:name", reference("n_name"))))


@query(rows("(SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)", ex("customer", "o_custkey"), EX + "orders", typed("n", "integer")))
def source_sql_query(spark, sf_dir):
    sql = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"
    return mapped(spark, sf_dir, triples_map("M", sql, f'rr:template "{EX}customer/{{o_custkey}}"', pom("ex:orders", reference("n"))))


@query(rows("events", "'<http://example.org/event/' || json_extract_string(props, '$.k') || '>'", EX + "k", plain("json_extract_string(props, '$.k')"), where="json_extract_string(props, '$.k') IS NOT NULL"))
def source_json_column(spark, sf_dir):
    src = Source(S.JsonColumn(sf_dir, "events", "props"), "$", (("k", "k"),))
    return _branch(src, f"{EX}event/", "k", "k", "k").execute(spark).text()


def _branch(src, prefix: str, key: str, predicate: str, value: str, encode: bool = True):
    part = FunctionCall(FUNCTIONS + "percentEncodeComponent", (Reference(key),)) if encode else Reference(key)
    op = Extend(src, "subject", FunctionCall(FUNCTIONS + "toIRI", (FunctionCall(FUNCTIONS + "concat", (Constant(Literal(prefix)), part)),)))
    op = Extend(op, "predicate", Constant(IRI(EX + predicate)))
    op = Extend(op, "object", FunctionCall(FUNCTIONS + "toLiteral", (Reference(value), Constant(XSD + "string"))))
    return Project(Extend(op, "graph", Constant(None)), ("subject", "predicate", "object", "graph"))


def _conversation_documents(spark, sf_dir) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select(F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("document"))


class _Documents(S.JsonColumn):
    """JSON documents that a query makes."""

    def documents(self, spark):
        return _conversation_documents(spark, self.folder)


CONVERSATION = rows("conversations", "'<http://example.org/turn/' || turn || '>'", EX + "role", plain("role"), where="role IS NOT NULL AND turn IS NOT NULL")


@query(CONVERSATION)
def source_json_iterator(spark, sf_dir):
    """Each turn of each conversation's document."""
    src = Source(_Documents(sf_dir, "conversations", "document"), "$.turns[*]", (("turn", "turn"), ("role", "$.role")))
    return _branch(src, f"{EX}turn/", "turn", "role", "role").execute(spark).text()


@query(rows("conversations", "'<http://example.org/conversation/' || conv_id || '>'", EX + "role", plain("role"), where="role IS NOT NULL"))
def source_json_flatten(spark, sf_dir):
    """All roles of a document, from one reference with a wildcard."""
    src = Source(_Documents(sf_dir, "conversations", "document"), "$", (("id", "id"), ("role", "turns[*].role")))
    return _branch(src, f"{EX}conversation/", "id", "role", "role").execute(spark).text()


@query(rows("conversations", "'<http://example.org/turn/' || turn || '>'", EX + "role", plain("role"), where="role = 'user' AND turn >= 1"))
def source_json_filter(spark, sf_dir):
    """The turns of each conversation's document for which a condition holds."""
    src = Source(_Documents(sf_dir, "conversations", "document"), "$.turns[?(@.role == 'user' && @.turn >= 1)]", (("turn", "turn"), ("role", "role")))
    return _branch(src, f"{EX}turn/", "turn", "role", "role").execute(spark).text()


@query(rows("conversations", "'<http://example.org/conversation/' || conv_id || '>'", EX + "role", plain("role"), where="role IS NOT NULL"))
def source_json_descent(spark, sf_dir):
    """All roles anywhere below a document."""
    src = Source(_Documents(sf_dir, "conversations", "document"), "$", (("id", "id"), ("role", "$..role")))
    return _branch(src, f"{EX}conversation/", "id", "role", "role").execute(spark).text()


@query(
    "SELECT '<http://example.org/role/' || a.role || '>' AS subject, '<http://example.org/turn>' AS predicate, '\"' || b.turn || '\"' AS object, CAST(NULL AS VARCHAR) AS graph "
    "FROM conversations a JOIN conversations b USING (conv_id) WHERE a.role IS NOT NULL AND b.turn IS NOT NULL"
)
def source_cartesian(spark, sf_dir):
    """Two references of many values each: all pairs of a document."""
    src = Source(_Documents(sf_dir, "conversations", "document"), "$", (("role", "turns[*].role"), ("turn", "turns[*].turn")))
    return _branch(src, f"{EX}role/", "role", "turn", "turn").execute(spark).text()


def _folder() -> str:
    """A new folder for a query's small files: in the folder that executors share, where that is one of this machine's paths."""
    spark = SparkSession.getActiveSession()
    shared = (spark.conf.get("spark.checkpoint.dir", None) if spark else None) or ""
    shared = re.sub(r"^file:/+", "/", shared)
    if shared.startswith("/"):
        os.makedirs(shared, exist_ok=True)
        return tempfile.mkdtemp(prefix="kgspark-files-", dir=shared)
    return tempfile.mkdtemp(prefix="kgspark-")


def _file(name: str, text: str) -> str:
    path = os.path.join(_folder(), name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _literal_rows(*triples: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '<{EX}{s}>' AS subject, '<{EX}{p}>' AS predicate, '\"{o}\"' AS object, CAST(NULL AS VARCHAR) AS graph" for s, p, o in triples)


@query(_literal_rows(("row/1", "name", "Ann"), ("row/2", "name", "")))
def source_csv(spark, sf_dir):
    """An empty cell is an empty literal, a missing one is no row."""
    path = _file("items.csv", "ID,user.name\n1,Ann\n2,\n3\n")
    return mapped(spark, sf_dir, f'ex:M rml:logicalSource [ rml:source "{path}" ; rml:referenceFormulation ql:CSV ] ; {pom("ex:name", reference("user.name"))} rr:subjectMap [ rr:template "{EX}row/{{ID}}" ] .')


@query(_literal_rows(("row/007", "name", "Ann"), ("row/8", "name", "Bo"), ("row/8", "name", "Cy")))
def source_xml(spark, sf_dir):
    path = _file("rows.xml", '<root><row code="007"><name>Ann</name></row><row code="8"><name>Bo</name><name>Cy</name></row><row code="9"/></root>')
    return mapped(spark, sf_dir, f'ex:M rml:logicalSource [ rml:source "{path}" ; rml:referenceFormulation ql:XPath ; rml:iterator "/root/row" ] ; {pom("ex:name", reference("name"))} rr:subjectMap [ rr:template "{EX}row/{{@code}}" ] .')


@query(_literal_rows(("row/1", "name", "Ann"), ("row/3", "name", "Cy")))
def source_xml_path(spark, sf_dir):
    """A path of several steps and a predicate: rows of other parents, and without the attribute, are none."""
    path = _file("paths.xml", '<root><a><row code="1"><name>Ann</name></row><row><name>Bo</name></row><row code="3"><name>Cy</name></row></a><b><row code="4"><name>Di</name></row></b></root>')
    return mapped(spark, sf_dir, f'ex:M rml:logicalSource [ rml:source "{path}" ; rml:referenceFormulation ql:XPath ; rml:iterator "/root/a/row[@code]" ] ; {pom("ex:name", reference("name"))} rr:subjectMap [ rr:template "{EX}row/{{@code}}" ] .')


@query(_literal_rows(("a", "name", "Ann"), ("b", "name", "Bo")))
def source_sparql(spark, sf_dir):
    """A local graph answers the query of a logical source."""
    path = _file("resource1.ttl", f'@prefix ex: <{EX}> . ex:a ex:n "Ann" . ex:b ex:n "Bo" ; ex:m 3 .')
    reader = S.SparqlSource("http://localhost:PORT/ds1", f"SELECT ?s ?n WHERE {{ ?s <{EX}n> ?n }}", os.path.dirname(path), f"{EX}ds1")
    src = Source(reader, "$.results.bindings[*]", (("s", "s.value"), ("n", "n.value")))
    op = Extend(src, "subject", FunctionCall(FUNCTIONS + "toIRI", (Reference("s"), Constant(None), Constant(False))))
    op = Extend(Extend(op, "predicate", Constant(IRI(EX + "name"))), "object", FunctionCall(FUNCTIONS + "toLiteral", (Reference("n"), Constant(XSD + "string"))))
    return Project(Extend(op, "graph", Constant(None)), ("subject", "predicate", "object", "graph")).execute(spark).text()


@query(
    "SELECT * FROM (VALUES ('<http://example.org/demo/1>', '<http://example.org/code>', '\"A  \"', CAST(NULL AS VARCHAR)), ('<http://example.org/demo/1>', '<http://example.org/created>', "
    f"'\"2024-01-02\"^^<{XSD}date>', NULL), ('<http://example.org/demo/1>', '<http://example.org/flag>', '\"true\"^^<{XSD}boolean>', NULL)) t(subject, predicate, object, graph)"
)
def source_sql_script(spark, sf_dir):
    """A script of tables, with the natural types of its columns."""
    path = _file("resource1.sql", "CREATE TABLE demo (id INTEGER, code CHAR(3), created DATE, flag BIT);\nINSERT INTO demo VALUES (1, 'A', '2024-01-02', 1);\nINSERT INTO demo VALUES (2, NULL, NULL, NULL);\n")
    reader = S.ScriptTables(os.path.dirname(path), "demo")
    parts = []
    for name in ("code", "created", "flag"):
        src = Source(reader, "$", (("id", "id"), (name, name)))
        parts.append(_branch(src, f"{EX}demo/", "id", name, name))
    return Union(tuple(parts)).execute(spark).text()


# Expressions and terms

PART = f'rr:template "{EX}part/{{p_partkey}}"'
PART_IRI = ex("part", "p_partkey")


@query(rows("part", PART_IRI, EX + "kind", "'\"part\"'"))
def extend_constant(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "part", PART, pom("ex:kind", 'rr:object "part"')))


@query(rows("part", PART_IRI, EX + "brand", plain("p_brand")))
def extend_reference(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "part", PART, pom("ex:brand", reference("p_brand"))))


@query(rows("part", PART_IRI, EX + "label", plain("p_brand || ': ' || p_type")))
def extend_function(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "part", PART, pom("ex:label", function("fn:concat", 'rml:reference "p_brand"', 'rr:constant ": "', 'rml:reference "p_type"'))))


@query(rows("supplier", ex("supplier", "s_suppkey"), EX + "nation", NATION.replace("n_nationkey", "s_nationkey")))
def template_iri(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "supplier", f'rr:template "{EX}supplier/{{s_suppkey}}"', pom("ex:nation", template(EX + "nation/{s_nationkey}"))))


ENCODED = "replace(url_encode({0}), '+', '%20')"


@query(rows("part", "'<" + EX + "name/' || " + ENCODED.format("p_name") + " || '>'", EX + "key", typed("p_partkey", "integer")))
def template_percent_encode(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "part", f'rr:template "{EX}name/{{p_name}}"', pom("ex:key", reference("p_partkey"))))


@query(rows("part", PART_IRI, EX + "text", plain("'name ' || " + ENCODED.format("p_name"))))
def template_literal(spark, sf_dir):
    """Templates encode their variables, those of literals too."""
    return mapped(spark, sf_dir, triples_map("M", "part", PART, pom("ex:text", template("name {p_name}", "; rr:termType rr:Literal"))))


@query(rows("lineitem", ex("line", "l_orderkey", "l_linenumber"), EX + "quantity", typed("CAST(l_quantity AS VARCHAR)", "decimal")))
def literal_datatype(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "lineitem", f'rr:template "{EX}line/{{l_orderkey}}/{{l_linenumber}}"', pom("ex:quantity", reference("l_quantity", "; rr:datatype xsd:decimal"))))


@query(rows("documents", ex("document", "doc_id"), EX + "source", "'\"' || source || '\"@en'"))
def literal_language(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "documents", f'rr:template "{EX}document/{{doc_id}}"', pom("ex:source", reference("source", '; rr:language "en"'))))


LINE = ex("line", "l_orderkey", "l_linenumber")


@query(
    " UNION ALL ".join(
        [
            rows("lineitem", LINE, EX + "price", typed("CAST(l_extendedprice AS VARCHAR)", "double")),
            rows("lineitem", LINE, EX + "part", typed("l_partkey", "integer")),
            rows("lineitem", LINE, EX + "flag", plain("l_returnflag")),
            rows("lineitem", LINE, EX + "shipped", typed("strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')", "dateTime")),
        ]
    )
)
def literal_natural_types(spark, sf_dir):
    names = {"price": "l_extendedprice", "part": "l_partkey", "flag": "l_returnflag", "shipped": "l_shipdate"}
    return mapped(spark, sf_dir, triples_map("M", "lineitem", f'rr:template "{EX}line/{{l_orderkey}}/{{l_linenumber}}"', *(pom(f"ex:{p}", reference(c)) for p, c in names.items())))


@query(rows("nation", "'_:' || n_name", EX + "key", typed("n_nationkey", "integer"), where="regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*')") + " UNION ALL " + rows("nation", "'_:b' || sha256(n_name)", EX + "key", typed("n_nationkey", "integer"), where="NOT regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*')"))
def bnode_label(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "nation", 'rml:reference "n_name" ; rr:termType rr:BlankNode', pom("ex:key", reference("n_nationkey"))))


@query(rows("part", "'_:b' || sha256(p_name)", EX + "key", typed("p_partkey", "integer"), where="p_name LIKE '% %'"))
def bnode_hash(spark, sf_dir):
    sql = "SELECT p_name, p_partkey FROM part WHERE p_name LIKE '% %'"
    return mapped(spark, sf_dir, triples_map("M", sql, 'rml:reference "p_name" ; rr:termType rr:BlankNode', pom("ex:key", reference("p_partkey"))))


@query(rows("nation", "'<http://base.example/n/' || n_name || '>'", EX + "key", typed("n_nationkey", "integer"), where="n_name NOT LIKE '% %'"))
def iri_reference_base(spark, sf_dir):
    """A reference is appended to the base; what is then no legal IRI is dropped."""
    return mapped(spark, sf_dir, triples_map("M", "nation", 'rml:reference "n_name" ; rr:termType rr:IRI', pom("ex:key", reference("n_nationkey"))), base="http://base.example/n/")


@query(rows("pages", "'<' || url || '>'", EX + "page", typed("page_id", "integer")))
def iri_absolute(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "pages", 'rml:reference "url"', pom("ex:page", reference("page_id"))))


@query("SELECT * FROM (SELECT '' AS subject, '' AS predicate, '' AS object, '' AS graph) WHERE FALSE")
def iri_invalid_drop(spark, sf_dir):
    """Texts with spaces are no IRIs, and no base makes them so."""
    return mapped(spark, sf_dir, triples_map("M", "documents", 'rml:reference "lang" ; rr:termType rr:IRI', pom("ex:id", reference("doc_id"))))


CUSTOMER = ex("customer", "c_custkey")
CUSTOMER_MAP = f'rr:template "{EX}customer/{{c_custkey}}"'


@query(rows("customer", CUSTOMER, TYPE, f"'<{EX}Customer>'") + " UNION ALL " + rows("customer", CUSTOMER, TYPE, f"'<{EX}Agent>'"))
def class_shortcut(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "customer", CUSTOMER_MAP + " ; rr:class ex:Customer, ex:Agent"))


@query(" UNION ALL ".join(rows("customer", CUSTOMER, EX + p, plain(c)) for p in ("a", "b") for c in ("c_name", "c_mktsegment")))
def multi_pom_expansion(spark, sf_dir):
    """Two predicates and two objects of one map: four triples, from one scan."""
    return mapped(spark, sf_dir, triples_map("M", "customer", CUSTOMER_MAP, f"rr:predicateObjectMap [ rr:predicate ex:a, ex:b ; {reference('c_name')}, [ rml:reference \"c_mktsegment\" ] ] ;"))


# Algebra by hand


def _names(sf_dir, table: str, column: str):
    return Project(Extend(Source(S.Table(table, sf_dir), "$", ((column, column),)), "name", Reference(column)), ("name",))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_bag(spark, sf_dir):
    op = _names(sf_dir, "nation", "n_name").union(_names(sf_dir, "region", "r_name"), _names(sf_dir, "nation", "n_name"))
    return op.execute(spark).terms().select(F.col("name.value").alias("name"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def union_distinct(spark, sf_dir):
    op = _names(sf_dir, "nation", "n_name").union(_names(sf_dir, "region", "r_name"), _names(sf_dir, "nation", "n_name"), distinct=True)
    return op.execute(spark).terms().select(F.col("name.value").alias("name"))


@query("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def project_attributes(spark, sf_dir):
    op = Source(S.Table("nation", sf_dir), "$", (("key", "n_nationkey"), ("name", "n_name"), ("region", "n_regionkey"))).project("name", "region")
    return op.execute(spark).terms().select(F.col("name.value").alias("name"), F.col("region.value").alias("region"))


def _joined(spark, left, right, on_left, on_right, **names):
    out = EquiJoin(left, right, tuple(on_left), tuple(on_right)).execute(spark).terms()
    return out.select(*(F.col(f"`{c}`.value").alias(n) for n, c in names.items()))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o, c_name AS c FROM orders JOIN customer ON o_custkey = c_custkey")
def equijoin_single(spark, sf_dir):
    orders = Source(S.Table("orders", sf_dir), "$", (("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey")))
    customers = Source(S.Table("customer", sf_dir), "$", (("c_custkey", "c_custkey"), ("c_name", "c_name")))
    return _joined(spark, orders, customers, ["o_custkey"], ["c_custkey"], o="o_orderkey", c="c_name")


@query("SELECT a.c_name AS a, s_name AS b FROM customer a JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def equijoin_composite(spark, sf_dir):
    left = Source(S.Table("customer", sf_dir), "$", (("c_nationkey", "c_nationkey"), ("c_custkey", "c_custkey"), ("c_name", "c_name")))
    right = Source(S.Table("supplier", sf_dir), "$", (("s_nationkey", "s_nationkey"), ("s_suppkey", "s_suppkey"), ("s_name", "s_name")))
    return _joined(spark, left, right, ["c_nationkey", "c_custkey"], ["s_nationkey", "s_suppkey"], a="c_name", b="s_name")


@query("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON CAST(n_regionkey AS VARCHAR) = CAST(r_regionkey AS VARCHAR)")
def equijoin_typed_keys(spark, sf_dir):
    """An integer meets a string of the same lexical form."""
    left = Source(S.Table("nation", sf_dir), "$", (("n_regionkey", "n_regionkey"), ("n_name", "n_name")))
    right = Source(S.SqlQuery("SELECT CAST(r_regionkey AS STRING) AS k, r_name FROM region", sf_dir, ("region",)), "$", (("k", "k"), ("r_name", "r_name")))
    return _joined(spark, left, right, ["n_regionkey"], ["k"], n="n_name", r="r_name")


@query("SELECT a.n_name AS a, b.r_name AS b FROM (SELECT n_name, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS k FROM nation) a JOIN (SELECT r_name, CASE WHEN r_regionkey > 2 THEN r_regionkey END AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def equijoin_null_safe(spark, sf_dir):
    """Epsilon meets epsilon."""
    marker = "http://kgspark.example/functions#above_two"
    FunctionRegistry.register(marker, lambda v: F.when(v.lex.cast("int") > 2, v.lex), "column")
    left = Source(S.Table("nation", sf_dir), "$", (("n_regionkey", "n_regionkey"), ("n_name", "n_name"))).extend("k", FunctionCall(marker, (Reference("n_regionkey"),)))
    right = Source(S.Table("region", sf_dir), "$", (("r_regionkey", "r_regionkey"), ("r_name", "r_name"))).extend("l", FunctionCall(marker, (Reference("r_regionkey"),)))
    return _joined(spark, left, right, ["k"], ["l"], a="n_name", b="r_name")


ORDER = ex("order", "o_orderkey")
ORDER_MAP = f'rr:template "{EX}order/{{o_orderkey}}"'


@query(rows("lineitem JOIN orders ON l_orderkey = o_orderkey", LINE, EX + "order", ORDER))
def ref_object_map_join(spark, sf_dir):
    text = triples_map("O", "orders", ORDER_MAP) + triples_map("L", "lineitem", f'rr:template "{EX}line/{{l_orderkey}}/{{l_linenumber}}"', pom("ex:order", 'rr:objectMap [ rr:parentTriplesMap ex:O ; rr:joinCondition [ rr:child "l_orderkey" ; rr:parent "o_orderkey" ] ]'))
    return mapped(spark, sf_dir, text)


@query(rows("orders", ORDER, EX + "customer", ex("customer", "o_custkey")))
def ref_object_map_nojoin(spark, sf_dir):
    """A parent map over the same rows, without a condition: the same row's subject."""
    text = triples_map("C", "orders", f'rr:template "{EX}customer/{{o_custkey}}"') + triples_map("O", "orders", ORDER_MAP, pom("ex:customer", "rr:objectMap [ rr:parentTriplesMap ex:C ]"))
    return mapped(spark, sf_dir, text)


@query("SELECT '<http://example.org/nation/' || n_nationkey || '>' AS subject, '<http://example.org/sees>' AS predicate, '<http://example.org/region/' || r_regionkey || '>' AS object, CAST(NULL AS VARCHAR) AS graph FROM nation CROSS JOIN region")
def cross_join_compat(spark, sf_dir):
    """A parent map over other rows, without a condition: all pairs."""
    text = triples_map("R", "region", f'rr:template "{EX}region/{{r_regionkey}}"') + triples_map("N", "nation", f'rr:template "{EX}nation/{{n_nationkey}}"', pom("ex:sees", "rr:objectMap [ rr:parentTriplesMap ex:R ]"))
    return mapped(spark, sf_dir, text)


# Graphs


@query(rows("orders", ORDER, EX + "status", plain("o_orderstatus"), f"'<{EX}orders>'"))
def graph_constant(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "orders", ORDER_MAP + " ; rr:graph ex:orders", pom("ex:status", reference("o_orderstatus"))))


EVENT, EVENT_MAP = ex("event", "event_id"), f'rr:template "{EX}event/{{event_id}}"'


@query(rows("events", EVENT, EX + "user", typed("user_id", "integer"), ex("type", "event_type")))
def graph_template(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "events", EVENT_MAP + f' ; rr:graphMap [ rr:template "{EX}type/{{event_type}}" ]', pom("ex:user", reference("user_id"))))


@query(" UNION ALL ".join(rows("events", EVENT, EX + "user", typed("user_id", "integer"), g) for g in (ex("type", "event_type"), f"'<{EX}all>'", f"'<{EX}own>'")))
def graph_multi(spark, sf_dir):
    """Graphs of the subject and of the predicate-object map: one quad for each."""
    return mapped(spark, sf_dir, triples_map("M", "events", EVENT_MAP + f' ; rr:graphMap [ rr:template "{EX}type/{{event_type}}" ] ; rr:graph ex:all', pom("ex:user", reference("user_id"), "; rr:graph ex:own")))


STATUS = rows("orders", ORDER, EX + "status", plain("o_orderstatus"))


@query(STATUS.replace("WHERE TRUE", "WHERE o_orderstatus <> 'F'") + " UNION ALL " + rows("orders", ORDER, EX + "status", plain("o_orderstatus"), f"'<{EX}done>'", "o_orderstatus = 'F'"))
def quad_suppresses_triple(spark, sf_dir):
    """A triple that is also in a named graph is not repeated in the default graph."""
    text = triples_map("A", "orders", ORDER_MAP, pom("ex:status", reference("o_orderstatus"))) + triples_map("B", "SELECT * FROM orders WHERE o_orderstatus = 'F'", ORDER_MAP + " ; rr:graph ex:done", pom("ex:status", reference("o_orderstatus")))
    return sinks.finalised(mapped(spark, sf_dir, text))


# Functions


@query(rows("events", EVENT, EX + "label", plain("event_type || '-' || user_id")))
def fn_concat(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "events", EVENT_MAP, pom("ex:label", function("fn:concat", 'rml:reference "event_type"', 'rr:constant "-"', 'rml:reference "user_id"'))))


def _condition(name: str, *args: str) -> str:
    inner = function(f"cond:{name}", *args).removeprefix("rr:objectMap [ ").removesuffix(" ]")
    return function("fn:toLiteral", inner, f'rr:constant "{XSD}boolean"')


@query(rows("events", EVENT, EX + "click", typed("CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END", "boolean")))
def fn_equal(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "events", EVENT_MAP, pom("ex:click", _condition("equal", 'rml:reference "event_type"', 'rr:constant "click"'))))


@query(rows("events", EVENT, EX + "other", typed("CASE WHEN event_type = 'click' THEN 'false' ELSE 'true' END", "boolean")))
def fn_not_equal(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "events", EVENT_MAP, pom("ex:other", _condition("notEqual", 'rml:reference "event_type"', 'rr:constant "click"'))))


@query(rows("events", EVENT, EX + "has", typed("CASE WHEN event_type <> '' THEN 'true' ELSE 'false' END", "boolean")))
def fn_true_condition(spark, sf_dir):
    return mapped(spark, sf_dir, triples_map("M", "events", EVENT_MAP, pom("ex:has", _condition("trueCondition", 'rml:reference "event_type"'))))


PAGE, PAGE_MAP = ex("page", "page_id"), f'rr:template "{EX}page/{{page_id}}"'


@query(rows("(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/turtle' WHEN 2 THEN 'text/csv' ELSE 'application/octet-stream' END AS m FROM pages)", PAGE, EX + "media", plain("m")))
def fn_mime(spark, sf_dir):
    sql = "SELECT page_id, concat('a/b.', page_id, element_at(array('.JSON', '.ttl', '.x.csv', '.bin'), cast(page_id % 4 as int) + 1)) AS f FROM pages"
    inner = function("cond:getMIMEType", 'rml:reference "f"').removeprefix("rr:objectMap [ ").removesuffix(" ]")
    return mapped(spark, sf_dir, triples_map("M", sql, PAGE_MAP, pom("ex:media", function("fn:toLiteral", inner, f'rr:constant "{XSD}string"'))))


@query(
    rows(
        f"(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://doi.org/10.1/' || page_id WHEN 1 THEN url WHEN 2 THEN '{BASES['id']}p%20' || page_id ELSE '{BASES['id']}' || sha256('||') END AS s FROM pages)",
        iri("s"), EX + "page", typed("page_id", "integer"),
    )
)
def fn_subject_for_row(spark, sf_dir):
    """Of an identifier, an address and a name, the first that is there."""
    sql = "SELECT page_id, if(page_id % 4 = 0, concat('10.1/', page_id), '') AS doi, if(page_id % 4 = 1, concat('<', url, '>'), '') AS u, if(page_id % 4 = 2, concat('p ', page_id), '') AS n FROM pages"
    subject = function("fn:subject_for_row", 'rml:reference "doi"', 'rml:reference "u"', 'rml:reference "n"').removeprefix("rr:objectMap [ ").removesuffix(" ]")
    return mapped(spark, sf_dir, triples_map("M", sql, subject, pom("ex:page", reference("page_id"))))


@query(rows("pages", PAGE, EX + "url", plain("url"), iri(f"'{BASES['graph']}crawl/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/2024' ELSE '' END")))
def fn_graph_for_source(spark, sf_dir):
    sql = "SELECT page_id, url, if(page_id % 2 = 0, '2024', 'http://error') AS y FROM pages"
    graph = function("fn:graph_for_source", 'rr:constant "crawl"', 'rml:reference "page_id"', 'rml:reference "y"').removeprefix("rr:objectMap [ ").removesuffix(" ]")
    return mapped(spark, sf_dir, triples_map("M", sql, PAGE_MAP + f" ; rr:graphMap [ {graph} ]", pom("ex:url", reference("url"))))


@query(rows("part", PART_IRI, EX + "loud", plain("upper(p_brand)")))
def udf_registry(spark, sf_dir):
    """A Python function, run in Arrow batches."""
    FunctionRegistry.register(EX + "upper", str.upper)
    return mapped(spark, sf_dir, triples_map("M", "part", PART, pom("ex:loud", function("ex:upper", 'rml:reference "p_brand"'))))


# Serialisation


@query("SELECT '<http://example.org/nation/' || n_nationkey || '> <http://example.org/name> ' || " + plain("n_name") + " || ' .' AS line FROM nation")
def serialize_ntriples(spark, sf_dir):
    return sinks.ntriples(source_table(spark, sf_dir))


@query("SELECT DISTINCT " + EVENT + " || ' <http://example.org/user> ' || " + typed("user_id", "integer") + " || ' ' || " + ex("type", "event_type") + " || ' .' AS line FROM events")
def serialize_nquads(spark, sf_dir):
    return sinks.nquads(graph_template(spark, sf_dir))


@query("SELECT DISTINCT " + ex("document", "doc_id") + " || ' <http://example.org/text> ' || " + plain("text") + " || ' .' AS line FROM documents")
def serialize_escape(spark, sf_dir):
    return sinks.ntriples(mapped(spark, sf_dir, triples_map("M", "documents", f'rr:template "{EX}document/{{doc_id}}"', pom("ex:text", reference("text")))))


@query("SELECT DISTINCT '<http://example.org/segment/' || c_mktsegment || '>' AS subject, '<http://example.org/in>' AS predicate, '<http://example.org/nation/' || c_nationkey || '>' AS object, CAST(NULL AS VARCHAR) AS graph FROM customer")
def finalize_dedup(spark, sf_dir):
    return sinks.finalised(mapped(spark, sf_dir, triples_map("M", "customer", f'rr:template "{EX}segment/{{c_mktsegment}}"', pom("ex:in", template(EX + "nation/{c_nationkey}")))))


# SPARQL


@query("SELECT " + ORDER + " AS o, " + plain("c_name") + " AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def sparql_bgp(spark, sf_dir):
    text = triples_map("O", "orders", ORDER_MAP, pom("ex:status", reference("o_orderstatus")), pom("ex:by", template(EX + "customer/{o_custkey}"))) + triples_map("C", "customer", CUSTOMER_MAP, pom("ex:name", reference("c_name")))
    return select(mapped(spark, sf_dir, text), f'PREFIX ex: <{EX}> SELECT ?o ?name WHERE {{ ?o ex:status "F" ; ex:by ?c . ?c ex:name ?name }}')


@query(
    "SELECT '<http://example.org/nation/' || c_nationkey || '>' AS nation, " + ", ".join(f"'\"' || {e} || '\"^^<{XSD}integer>' AS {n}" for e, n in (("count(*)", "orders"), ("count(DISTINCT o_custkey)", "buyers"), ("sum(o_orderkey + o_custkey)", "total"), ("max(o_custkey)", "largest"))) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(*) > 10"
)
def sparql_aggregates(spark, sf_dir):
    """Aggregates over a path of two steps."""
    text = triples_map("O", "SELECT o_orderkey, o_custkey, o_orderkey + o_custkey AS score FROM orders", ORDER_MAP, pom("ex:by", template(EX + "customer/{o_custkey}")), pom("ex:key", reference("o_custkey")), pom("ex:score", reference("score")))
    text += triples_map("C", "customer", CUSTOMER_MAP, pom("ex:in", template(EX + "nation/{c_nationkey}")))
    names = "?nation (COUNT(*) AS ?orders) (COUNT(DISTINCT ?k) AS ?buyers) (SUM(?s) AS ?total) (MAX(?k) AS ?largest)"
    return select(mapped(spark, sf_dir, text), f"PREFIX ex: <{EX}> SELECT {names} WHERE {{ ?o ex:by/ex:in ?nation ; ex:key ?k ; ex:score ?s }} GROUP BY ?nation HAVING (COUNT(?o) > 10)")


@query("SELECT " + CUSTOMER + " AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def sparql_not_exists(spark, sf_dir):
    text = triples_map("O", "orders", ORDER_MAP, pom("ex:by", template(EX + "customer/{o_custkey}"))) + triples_map("C", "customer", CUSTOMER_MAP, pom("ex:name", reference("c_name")))
    return select(mapped(spark, sf_dir, text), f"PREFIX ex: <{EX}> SELECT ?c WHERE {{ ?c ex:name ?name FILTER NOT EXISTS {{ ?o ex:by ?c }} }}")


@query("WITH RECURSIVE up(n, m) AS (SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0 UNION SELECT n, m // 2 FROM up WHERE m > 0) SELECT '<http://example.org/nation/' || n || '>' AS n, '<http://example.org/nation/' || m || '>' AS up FROM up")
def sparql_path_any_length(spark, sf_dir):
    text = triples_map("N", "SELECT n_nationkey, n_nationkey DIV 2 AS half FROM nation WHERE n_nationkey > 0", f'rr:template "{EX}nation/{{n_nationkey}}"', pom("ex:up", template(EX + "nation/{half}")))
    return select(mapped(spark, sf_dir, text), f"PREFIX ex: <{EX}> SELECT ?n ?up WHERE {{ ?n ex:up+ ?up }}")


@query("SELECT " + NATION + " AS n, " + plain("n_name") + " AS name, CASE WHEN n_nationkey > 20 THEN " + plain("r_name") + " END AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 3 AND n_name <> 'CHINA'")
def sparql_optional_filter(spark, sf_dir):
    text = triples_map("N", "nation", f'rr:template "{EX}nation/{{n_nationkey}}"', pom("ex:name", reference("n_name")), pom("ex:key", reference("n_nationkey"))) + triples_map(
        "R", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 20", f'rr:template "{EX}nation/{{n_nationkey}}"', pom("ex:region", reference("r_name"))
    )
    return select(mapped(spark, sf_dir, text), f'PREFIX ex: <{EX}> SELECT ?n ?name ?region WHERE {{ ?n ex:name ?name ; ex:key ?k . OPTIONAL {{ ?n ex:region ?region }} FILTER(?k >= 3 && ?name != "CHINA") }}')


@query("SELECT " + NATION + " AS n, CASE WHEN n_nationkey > n_regionkey * 6 THEN '\"' || n_regionkey || '\"^^<" + XSD + "integer>' END AS less FROM nation")
def sparql_optional_outer(spark, sf_dir):
    """A filter of an optional part that compares with a variable outside it."""
    subject = f'rr:template "{EX}nation/{{n_nationkey}}"'
    text = triples_map("N", "nation", subject, pom("ex:key", reference("n_nationkey"))) + triples_map("R", "nation", subject, pom("ex:region", reference("n_regionkey"))) + triples_map("S", "SELECT n_nationkey, n_regionkey * 6 AS six FROM nation", subject, pom("ex:six", reference("six")))
    return select(mapped(spark, sf_dir, text), f'PREFIX ex: <{EX}> SELECT ?n ?less WHERE {{ ?n ex:key ?k . OPTIONAL {{ ?n ex:region ?less ; ex:six ?six FILTER(?k > ?six) }} }}')


@query("SELECT '<http://example.org/r' || i || '>' AS repo, '\"Issue ' || i || '\"' AS title FROM range(1, 4) t(i)")
def sparql_service_call(spark, sf_dir):
    """A mapping for each value, each into a graph of its own."""
    folder = _folder()
    for i in (1, 2, 3):
        with open(os.path.join(folder, f"r{i}.json"), "w", encoding="utf-8") as f:
            f.write(f'{{"issues": [{{"id": "{i}", "title": "Issue {i}"}}]}}')
        with open(os.path.join(folder, f"r{i}_mapping.ttl"), "w", encoding="utf-8") as f:
            f.write(PREFIX + f'ex:M rml:logicalSource [ rml:source "r{i}.json" ; rml:referenceFormulation ql:JSONPath ; rml:iterator "$.issues[*]" ] ; {pom("ex:title", reference("title"))} rr:subjectMap [ rr:template "{EX}issue/{{id}}" ] .')
    text = f'PREFIX ex: <{EX}> SELECT ?repo ?title WHERE {{ VALUES ?repo {{ ex:r1 ex:r2 ex:r3 }} BIND SERVICE-CALL(?repo, "mapping.ttl") AS ?g GRAPH ?g {{ ?y ex:title ?title }} }}'
    return service_call(spark, text.replace("ex:r", f"<{EX}r").replace("r1 ", "r1> ").replace("r2 ", "r2> ").replace("r3 ", "r3> "), folder)


# The whole schema

_KG = (
    triples_map("Region", "region", f'rr:template "{EX}region/{{r_regionkey}}" ; rr:class ex:Region', pom("ex:name", reference("r_name"))),
    triples_map("Nation", "nation", f'rr:template "{EX}nation/{{n_nationkey}}" ; rr:class ex:Nation', pom("ex:name", reference("n_name")), pom("ex:region", template(EX + "region/{n_regionkey}"))),
    triples_map("Customer", "customer", CUSTOMER_MAP + " ; rr:class ex:Customer", pom("ex:name", reference("c_name")), pom("ex:segment", reference("c_mktsegment")), pom("ex:balance", reference("c_acctbal"))),
    triples_map("Order", "orders", ORDER_MAP + " ; rr:class ex:Order", pom("ex:total", reference("o_totalprice")), pom("ex:status", reference("o_orderstatus")),
                pom("ex:customer", 'rr:objectMap [ rr:parentTriplesMap ex:Customer ; rr:joinCondition [ rr:child "o_custkey" ; rr:parent "c_custkey" ] ]')),
    triples_map("Line", "lineitem", f'rr:template "{EX}line/{{l_orderkey}}/{{l_linenumber}}"', pom("ex:order", template(EX + "order/{l_orderkey}")), pom("ex:part", template(EX + "part/{l_partkey}")), pom("ex:price", reference("l_extendedprice"))),
)


@query(
    " UNION ALL ".join(
        [
            rows("region", ex("region", "r_regionkey"), TYPE, f"'<{EX}Region>'"), rows("region", ex("region", "r_regionkey"), EX + "name", plain("r_name")),
            rows("nation", NATION, TYPE, f"'<{EX}Nation>'"), rows("nation", NATION, EX + "name", plain("n_name")), rows("nation", NATION, EX + "region", ex("region", "n_regionkey")),
            rows("customer", CUSTOMER, TYPE, f"'<{EX}Customer>'"), rows("customer", CUSTOMER, EX + "name", plain("c_name")), rows("customer", CUSTOMER, EX + "segment", plain("c_mktsegment")),
            rows("customer", CUSTOMER, EX + "balance", typed("CAST(c_acctbal AS VARCHAR)", "double")),
            rows("orders", ORDER, TYPE, f"'<{EX}Order>'"), rows("orders", ORDER, EX + "total", typed("CAST(o_totalprice AS VARCHAR)", "double")), rows("orders", ORDER, EX + "status", plain("o_orderstatus")),
            rows("orders JOIN customer ON o_custkey = c_custkey", ORDER, EX + "customer", CUSTOMER),
            rows("lineitem", LINE, EX + "order", ex("order", "l_orderkey")), rows("lineitem", LINE, EX + "part", ex("part", "l_partkey")), rows("lineitem", LINE, EX + "price", typed("CAST(l_extendedprice AS VARCHAR)", "double")),
        ]
    )
)
def kg_full(spark, sf_dir):
    return mapped(spark, sf_dir, "\n".join(_KG))
