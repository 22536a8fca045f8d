r"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every text is a blob, known by the SHA-256 of its UTF-8 bytes, whatever the ids, paths and versions that hold
it. The ledger keeps, for each blob and rule version, what a scan found. A scan takes the blobs whose pair with
this rule version the ledger lacks, each once, appends their findings, and joins findings back to all rows.

Rules are patterns; matches are leftmost and do not overlap, per kind. Of `assign`, the value (group 2) must
have 6 characters. A greedy run with a least length equals all greedy runs without the short ones, so the
lengths of `access` and `hex` stand in their patterns. Places are code points: the pieces between matches
(split) and the matches (regexp_extract_all) alternate, and their lengths add up, as running sums over rows. Time and memory are
linear in a text's length and its number of matches.

Null text: as an empty one, no findings. Equal rows all get the findings; null ids are kept. Empty table: no rows, and nothing to the
ledger. Spans that start together are in the order of the rules. Very long texts are scanned whole. Names of other columns may clash; redact keeps them in a struct.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm._spark import scratch, store, table

#: Kind, pattern, and whether its group 2 needs 6 characters; the first three are the base rules.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True),
    ("access", r"AKIA[A-Z0-9]{16,}", False),
    ("hex", r"[0-9a-f]{24,}", False),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", False),
)
BASE = 3


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


FOUND = "array<struct<start:int,rank:int,kind:string,end:int,from:int,to:int,before:int>>"


def _matches(rank: int, kind: str, pattern: str, valued: bool, text: str = "text") -> str:
    """SQL: the matches of a kind in a text, as an array of rank, kind, nth, the lengths of the gap before it and of itself (in code points and bytes), and whether it counts."""
    p = _quoted(pattern)
    ok = f"x.hit is not null and length(regexp_extract(x.hit, {p}, 2)) >= 6" if valued else "x.hit is not null"
    parts = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, hit) -> named_struct('gap', gap, 'hit', hit))"
    made = f"named_struct('rank', {rank}, 'kind', '{kind}', 'nth', i, 'gap', length(x.gap), 'hit', coalesce(length(x.hit), 0), 'gap_bytes', octet_length(x.gap), 'hit_bytes', coalesce(octet_length(x.hit), 0), 'ok', {ok})"
    none = "cast(array() as array<struct<rank:int,kind:string,nth:int,gap:int,hit:int,gap_bytes:int,hit_bytes:int,ok:boolean>>)"
    return f"if(rlike({text}, {p}), transform({parts}, (x, i) -> {made}), {none})"


def _said(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def findings(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs: blob (each once), text. Gives blob and found: its spans in order, in code points (start, end) and bytes (from, to; before: where the spans before it end)."""
    every = ", ".join(_matches(i, *rule) for i, rule in enumerate(rules))
    rows = blobs.select("blob", F.explode_outer(F.expr(f"concat({every})")).alias("x")).select("blob", "x.*")
    # Running sums over a blob's matches, as rows: linear, however many there are. Blobs are dealt by their hash already.
    past = Window.partitionBy("blob", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(past).cast("int")).withColumn("to", F.sum(F.col("gap_bytes") + F.col("hit_bytes")).over(past).cast("int"))
    rows = rows.select("blob", "rank", "kind", "ok", (F.col("end") - F.col("hit")).alias("start"), "end", (F.col("to") - F.col("hit_bytes")).alias("from"), "to")
    earlier = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.max(F.when(F.col("ok"), F.col("to"))).over(earlier), F.lit(0)))
    span = F.when(F.col("ok"), F.struct("start", "rank", "kind", "end", "from", "to", "before"))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))  # empty where nothing counts


def scan(documents: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """id_col, blob, found (array of start, rank, kind, end) of each row. ledger: a path that is kept between scans; none: a new one."""
    rows = _blobs(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text")
    return _joined(rows, ledger, rules).select(F.col("id").alias(id_col), "blob", "found")


def redact(documents: DataFrame, ledger: str | None = None, text_col: str = "text", length_col: str | None = "n_chars", rules=RULES) -> DataFrame:
    """documents with marks in place of their secrets, and with length_col, if there is one, as the new text's length where a text has changed."""
    carried = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("kept"), F.col(text_col).cast("string").alias("text"))
    new = F.when(F.size("found") > 0, redacted("text", "found")).otherwise(F.col("kept")[text_col])
    out = _joined(_blobs(carried, "text"), ledger, rules).select(F.col("kept").withField(text_col, new).alias("kept"), "found")
    if length_col in documents.columns:
        long = F.length(F.col("kept")[text_col]).cast(documents.schema[length_col].dataType)
        out = out.withColumn("kept", F.col("kept").withField(length_col, F.when(F.size("found") > 0, long).otherwise(F.col("kept")[length_col])))
    return out.select("kept.*")


def _blobs(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _joined(rows: DataFrame, ledger: str | None, rules) -> DataFrame:
    """rows: text, blob and others. Scans what the ledger lacks and adds found to all rows."""
    spark, version = rows.sparkSession, rule_version(rules)
    path = ledger or scratch(spark, "ledger")
    known = ledger_rows(spark, path)
    fresh = rows.select("blob", F.coalesce("text", F.lit("")).alias("text"))
    if known is not None:
        fresh = fresh.join(known.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    fresh = fresh.groupBy("blob").agg(F.any_value("text").alias("text"))
    store(findings(fresh, rules).withColumn("rules", F.lit(version)), path, "append")
    found = ledger_rows(spark, path).where((F.col("rules") == version) & (F.size("found") > 0)).select(F.col("blob").alias("found_blob"), F.col("found").alias("was_found"))
    found = found.dropDuplicates(["found_blob"]) if known is not None else found
    none = F.array().cast(found.schema["was_found"].dataType)
    return rows.join(found, F.col("blob") == F.col("found_blob"), "left").withColumn("found", F.coalesce("was_found", none)).drop("found_blob", "was_found")


def ledger_rows(spark, path: str) -> DataFrame | None:
    """What the ledger holds: blob, found, rules; None if there is none yet. A pair that two scans at a time have both added counts once."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"blob string, found {FOUND}, rules string").parquet(path)


def redacted(text: str, found: str, mark: str = "[REDACTED]"):
    """Of columns by name: a text without its spans; spans that overlap are one. Pieces are cut by bytes, so that each is reached at once."""
    cut = lambda begin, size: f"cast(substring(b, {begin} + 1, {size}) as string)"
    pieces = f"transform({found}, x -> if(x.from >= x.before, concat({cut('x.before', 'x.from - x.before')}, '{mark}'), ''))"
    last = f"aggregate({found}, 0, (a, x) -> greatest(a, x.to))"
    tail = f"transform(array({last}), z -> {cut('z', 'octet_length(b)')})[0]"
    return F.expr(f"if(size({found}) = 0, {text}, transform(array(cast({text} as binary)), b -> concat(array_join({pieces}, ''), {tail}))[0])")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = f"filter(found, x -> x.rank < {BASE})"
    count = lambda kind: F.expr(f"cast(size(filter(found, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(F.expr(_said(base)), 256).alias("base_sha256"), F.expr(_said("found")).alias("spans"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _sql_spans(rank: int, kind: str, pattern: str, valued: bool) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    ok = f"length(regexp_extract(h, {p}, 2)) >= 6" if valued else "TRUE"
    return (
        f"SELECT doc_id, s AS start, {rank} AS rank, '{kind}' AS kind, s + length(h) AS stop FROM (SELECT doc_id, hits[i] AS h, "
        "CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s "
        f"FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits FROM d))) WHERE {ok}"
    )


#: Either case of the key's letters, without the folding of letters beyond ASCII.
_SQL_RULES = [(k, "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)") + p.split("key)", 1)[1][1:] if k == "assign" else p, v) for k, p, v in RULES]

OP2_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_sql_spans(i, *rule) for i, rule in enumerate(_SQL_RULES))
    + """), g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
)
