"""Tables: Parquet and catalogue tables, SQL queries, JDBC, SQL scripts, CSV."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.terms import Val, natural
from kgspark.sources.base import Reader, check_strict, find_name


class _Columns(Reader):
    """One value for each column: NULL is no value."""

    single_valued = True
    typed = True

    def frame(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def read(self, spark, iterator: str, mappings: dict[str, str], strict: bool = False, keep_missing: bool = False) -> tuple[DataFrame, dict[str, Val]]:
        df = self.frame(spark)
        kinds = dict(df.dtypes)
        values, columns = {}, []
        for a, query in mappings.items():
            name, path = self._column(df, query)
            if name is None:
                if strict:
                    raise KeyError(f"no column {query!r} among {df.columns}")
                values[a] = Val(F.lit(None).cast("string"))
                continue
            c = F.col(f"`{name}`")
            kind = kinds[name]
            for step in path:
                c = c[step]
            if path:
                kind = df.select(c.alias("x")).dtypes[0][1]
            columns.append(c)
            values[a] = replace(natural(c, kind) if self.typed else Val(c.cast("string")), there=c.isNotNull())
        if strict and columns:
            check_strict(df.select(*(F.max(c.isNotNull().cast("int")).alias(f"{a}") for a, c in zip([a for a in mappings if values[a].lex is not None], columns, strict=False))))
        if not keep_missing and mappings:
            df = df.where(reduce(and_, (v.lex.isNotNull() for v in values.values()))) if len(columns) < len(mappings) else df.where(reduce(and_, (c.isNotNull() for c in columns)))
        return df, values

    def _column(self, df: DataFrame, query: str) -> tuple[str | None, list[str]]:
        name = find_name(df.columns, query)
        if name is not None:
            return name, []
        # A dotted name walks into structs.
        head, *rest = query.removeprefix("$.").split(".")
        name = find_name(df.columns, head)
        return (name, rest) if rest and name is not None and dict(df.dtypes)[name].startswith("struct") else (None, [])


@dataclass(frozen=True)
class Table(_Columns):
    """A table by name: <folder>/<name>.parquet if a folder is given, else of the catalogue."""

    name: str
    folder: str | None = None

    def frame(self, spark):
        return spark.read.parquet(f"{self.folder}/{self.name}.parquet") if self.folder else spark.table(self.name)

    def facts(self):
        return [("table_name", self.name)]


@dataclass(frozen=True)
class SqlQuery(_Columns):
    """A Spark SQL query; the tables of a folder, if given, are views for it."""

    query: str
    folder: str | None = None
    tables: tuple[str, ...] = ()

    def frame(self, spark):
        if not self.query.strip():
            raise ValueError("an empty query")
        names = {t: spark.read.parquet(f"{self.folder}/{t}.parquet") for t in self.tables if re.search(rf"\b{re.escape(t)}\b", self.query)}
        for t, df in names.items():
            df.createOrReplaceTempView(t)
        return spark.sql(self.query.rstrip().rstrip(";"))

    def facts(self):
        return [("query", self.query)]


@dataclass(frozen=True, eq=False)
class Frame(_Columns):
    """A DataFrame."""

    df: DataFrame
    typed: bool = True  # type: ignore[misc]

    def frame(self, spark):
        return self.df


@dataclass(frozen=True)
class JdbcTable(_Columns):
    """A table or query over JDBC. dsn: a JDBC URL, a URL of the kind postgresql://, mysql:// or mssql://, or an ODBC string."""

    dsn: str
    table: str | None = None
    query: str | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    partitioning: tuple[tuple[str, str], ...] = ()

    def frame(self, spark):
        options = {"url": jdbc_url(self.dsn)} | {k: v for k, v in (("user", self.user), ("password", self.password), ("driver", self.driver)) if v}
        options |= {"query": self.query} if self.query else {"dbtable": self.table}
        return spark.read.format("jdbc").options(**options, **dict(self.partitioning)).load()

    def facts(self):
        return [("dsn", self.dsn), ("query", self.query), ("table_name", self.table)]


def jdbc_url(dsn: str) -> str:
    if dsn.startswith("jdbc:"):
        return dsn
    m = re.match(r"(mysql|postgres(?:ql)?|mssql|sqlserver)(?:\+\w+)?://(.*)", dsn)
    if m:
        kind = {"postgres": "postgresql", "mssql": "sqlserver"}.get(m[1], m[1])
        rest = re.sub(r"^[^@/]*@", "", m[2])
        if kind == "sqlserver":
            host, _, base = rest.partition("/")
            return f"jdbc:sqlserver://{host}" + (f";databaseName={base}" if base else "")
        return f"jdbc:{kind}://{rest}"
    parts = {k.strip().lower(): v.strip().strip("{}") for k, _, v in (p.partition("=") for p in dsn.split(";")) if k.strip()}
    if "server" in parts:
        return f"jdbc:sqlserver://{parts['server'].replace(',', ':')}" + (f";databaseName={parts['database']}" if "database" in parts else "")
    raise ValueError(f"no data source name: {dsn!r}")


def database_kind(driver: str | None, dsn: str | None) -> str | None:
    """mysql, postgresql or sqlserver, by words of the driver's or the source's name."""
    text = f"{driver or ''} {dsn or ''}".lower()
    return next((k for k, words in (("mysql", ("mysql", "mariadb")), ("postgresql", ("postgres",)), ("sqlserver", ("sqlserver", "mssql", "odbc"))) if any(w in text for w in words)), None)


@dataclass(frozen=True)
class ScriptTables(_Columns):
    """A query over the tables of a folder's first resource*.sql, run in SQLite on the driver (small fixtures only)."""

    folder: str
    table: str | None = None
    query: str | None = None
    strict_names: bool = False

    def frame(self, spark):
        import sqlite3

        from pyspark.sql import types as T

        scripts = sorted(f for f in os.listdir(self.folder) if re.fullmatch(r"resource.*\.sql", f))
        if not scripts:
            raise FileNotFoundError(f"no resource*.sql in {self.folder}")
        with open(os.path.join(self.folder, scripts[0]), encoding="utf-8") as f:
            script = f.read()
        if self.strict_names and (not self.table or self.table != self.table.lower()):
            raise ValueError(f"no table {self.table!r}")
        hints = script_types(script)
        with sqlite3.connect(":memory:") as base:
            base.create_function("concat_ws", -1, lambda sep, *a: sep.join(str(x) for x in a if x is not None))
            base.executescript(portable(script))
            sql = portable(self.query) if self.query else f'SELECT * FROM "{self.table}"'
            try:
                cursor = base.execute(sql)
            except sqlite3.OperationalError as e:
                if "no such table" in str(e) and not self.strict_names:
                    return spark.createDataFrame([], "none string")
                raise
            names, rows = [d[0] for d in cursor.description], cursor.fetchall()
        fields, out = [], []
        for i, name in enumerate(names):
            cells = [r[i] for r in rows]
            kind, fixed = _cell_type(hints.get(name.lower(), ""), cells)
            fields.append(T.StructField(name, kind))
            out.append([fixed(c) if c is not None else None for c in cells])
        return spark.createDataFrame([tuple(c) for c in zip(*out, strict=True)], T.StructType(fields))


def portable(sql: str) -> str:
    """What SQLite takes of other dialects' scripts."""
    lines = [x for x in sql.splitlines() if not re.match(r"\s*(USE|CREATE\s+DATABASE|DROP\s+DATABASE|SET|EXEC|GO)\b", x, re.I)]
    sql = re.sub(r"\bCASCADE\b", "", "\n".join(lines), flags=re.I)
    sql = re.sub(r"\btest\.", "", sql)
    sql = re.sub(r"\b0x([0-9A-Fa-f]+)\b", r"X'\1'", sql)
    sql = re.sub(r"\bCAST\s*\(\s*'([0-9A-Fa-f]+)'\s+AS\s+VARBINARY\s*(?:\([^)]*\))?\s*\)", r"X'\1'", sql, flags=re.I)
    sql = re.sub(r"'\\x([0-9A-Fa-f]+)'", r"X'\1'", sql)
    return re.sub(r"`", '"', sql)


def script_types(script: str) -> dict[str, str]:
    out = {}
    for body in re.findall(r"CREATE\s+TABLE[^(]*\((.*?)\)\s*;", script, re.I | re.S):
        for part in re.split(r",(?![^(]*\))", body):
            m = re.match(r"""\s*["`\[]?(\w+)["`\]]?\s+(\w+(?:\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\))?)""", part)
            if m and m[1].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK"):
                out[m[1].lower()] = m[2].upper()
    return out


def _cell_type(hint: str, cells: list):
    from decimal import Decimal

    from pyspark.sql import types as T

    if re.match(r"BIT|BOOL", hint):
        return T.BooleanType(), lambda c: str(c).lower() in ("1", "true", "t", "b'1'")
    if m := re.match(r"CHAR\s*\(\s*(\d+)", hint):
        return T.StringType(), lambda c: str(c).ljust(int(m[1]))
    if re.match(r"DECIMAL|NUMERIC", hint) and all(isinstance(c, (int, float)) or c is None for c in cells):
        return T.DecimalType(38, 10), lambda c: Decimal(str(c))
    seen = {type(c) for c in cells if c is not None}
    if seen == {int} and not re.match(r"FLOAT|DOUBLE|REAL", hint):
        return T.LongType(), int
    if seen and seen <= {int, float}:
        return T.DoubleType(), float
    if seen == {bytes}:
        return T.BinaryType(), bytes
    return T.StringType(), str


@dataclass(frozen=True)
class CsvFile(_Columns):
    """CSV with a header. An empty cell is an empty string; a cell that a short row lacks has no value."""

    path: str
    typed = False

    def frame(self, spark):
        bad = "__record"
        head = spark.read.csv(self.path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"')
        fields = [f"`{c.replace('`', '``')}` string" for c in head.columns]
        df = spark.read.csv(self.path, header=True, schema=", ".join([*fields, f"{bad} string"]), columnNameOfCorruptRecord=bad, mode="PERMISSIVE", multiLine=True, escape='"', enforceSchema=True)
        # Of the records that do not fit, the number of cells: separators that are not within quotes.
        cells = F.size(F.split(F.regexp_replace(F.col(bad), r'"(?:[^"]|"")*"', "q"), ",", -1))
        out = []
        for i, c in enumerate(head.columns):
            name = F.col(f"`{c}`")
            out.append(F.when(F.col(bad).isNull() | (cells > i), F.coalesce(name, F.lit(""))).alias(c))
        return df.select(*out)

    def facts(self):
        return [("path", self.path)]
