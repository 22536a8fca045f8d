"""Logical sources. Each reads (spark, iterator, {attribute: query}) to a DataFrame and the attributes' values."""

from kgspark.sources.json import JsonColumn, JsonFile
from kgspark.sources.rdf import SparqlSource
from kgspark.sources.tables import CsvFile, Frame, JdbcTable, ScriptTables, SqlQuery, Table
from kgspark.sources.xml import XmlFile

__all__ = ["CsvFile", "Frame", "JdbcTable", "JsonColumn", "JsonFile", "ScriptTables", "SparqlSource", "SqlQuery", "Table", "XmlFile"]
