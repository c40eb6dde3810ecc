"""Extraction and diffs over sources made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import code, diffs
from ..functions import text
from ..functions.snip import snip_quotes
from ..operators import graph
from ..sources.mail import mbox_lines, parse_mails
from .base import Tables, query


def _sources(t: Tables) -> DataFrame:
    """A C file for every twenty parts: a struct, a macro, and functions that call each other by the derived edges."""
    callees = t.edges.groupBy(F.col("caller").cast("bigint").alias("id")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    rows = t.part.select(F.col("p_partkey").alias("id"), "p_name", "p_size").join(callees.hint("merge"), "id", "left")
    calls = F.concat_ws("", F.transform(F.coalesce("callees", F.array()), lambda c: F.concat(F.lit("\tp"), c, F.lit("(s); /* p0(s) */\n"))))
    function = F.concat(F.lit("/* "), "p_name", F.lit(" */\nstatic int p"), F.col("id").cast("string"), F.lit("(struct part *s, unsigned int n)\n{\n"), calls, F.lit('\treturn "p1(";\n}\n'))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", function.alias("f")))), lambda x: x["f"]), "\n")
    files = rows.groupBy(F.floor(F.col("id") / 20).alias("n")).agg(lines.alias("body"))
    head = F.concat(F.lit("#define TWICE"), F.col("n").cast("string"), F.lit("(x) twice(x, x)\nstruct part"), F.col("n").cast("string"), F.lit(" { int a, *b; char c[4]; };\n\n"))
    content = F.concat(head, "body")
    return files.select(F.concat(F.lit("src/f"), F.col("n").cast("string"), F.lit(".c")).alias("file_path"), F.sha1(content.cast("binary")).alias("git_file_hash"), content.alias("content"))


@query(
    "u01_functions",
    "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS name, 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c' AS file_path, 'int' AS return_type, 's|n' AS parameters FROM {part} UNION ALL SELECT DISTINCT 'TWICE' || CAST(p_partkey // 20 AS VARCHAR), 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c', '', 'x' FROM {part}",
)
def functions(t: Tables) -> DataFrame:
    found = code.functions_of(code.extract_sources(_sources(t)))
    return found.select("name", "file_path", "return_type", F.array_join(F.transform("parameters", lambda p: p["name"]), "|").alias("parameters"))


@query("u02_calls", "SELECT DISTINCT 'p' || caller AS caller, 'p' || callee AS callee FROM {edges} UNION ALL SELECT DISTINCT 'TWICE' || CAST(p_partkey // 20 AS VARCHAR), 'twice' FROM {part}")
def calls(t: Tables) -> DataFrame:
    return graph.call_edges(code.functions_of(code.extract_sources(_sources(t))))


@query("u03_types", "SELECT DISTINCT 'part' || CAST(p_partkey // 20 AS VARCHAR) AS name, 'struct' AS kind, 'a int|b int *|c char[4]' AS fields FROM {part}")
def types(t: Tables) -> DataFrame:
    found = code.types_of(code.extract_sources(_sources(t)))
    return found.select("name", "kind", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(" "), f["type_name"])), "|").alias("fields"))


@query("u04_typedefs", "SELECT p_partkey, 't' || CAST(p_partkey AS VARCHAR) AS name, '// Underlying type: unsigned long' AS head FROM {part}")
def typedefs(t: Tables) -> DataFrame:
    source = t.part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".h")).alias("file_path"), F.lit("h").alias("git_file_hash"), F.concat(F.lit("typedef unsigned long t"), F.col("p_partkey").cast("string"), F.lit(";\n")).alias("content"))
    found = code.types_of(code.extract_sources(source))
    return found.select(F.regexp_extract("file_path", r"f(\d+)", 1).cast("bigint").alias("p_partkey"), "name", F.substring_index("definition", "\n", 1).alias("head"))


@query("u05_macros", "SELECT DISTINCT 'TWICE' || CAST(p_partkey // 20 AS VARCHAR) AS name, 'twice' AS calls FROM {part}")
def macros(t: Tables) -> DataFrame:
    return code.extract_sources(_sources(t)).where("kind = 'macro'").select("name", F.array_join("calls", "|").alias("calls"))


@query("u07_parameter_types", "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS name, 'include/part.h' AS type_file_path FROM {part}")
def parameter_types(t: Tables) -> DataFrame:
    found = code.functions_of(code.extract_sources(_sources(t)))
    known = t.spark.createDataFrame([("part", "include/part.h", "h")], "name string, file_path string, git_file_hash string")
    return code.resolve_parameter_types(found, known).where("type_file_path IS NOT NULL").select("name", "type_file_path")


def _diffs(t: Tables) -> DataFrame:
    """Each source file with one function's return changed."""
    old = _sources(t).withColumnRenamed("content", "old")
    new = F.regexp_replace("old", r'return "p1\(";\n\}\n$', "return changed(n);\n}\n")
    return diffs.diff_texts(old.withColumn("new", new))


@query("u12_diff_text", "SELECT 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c' AS file_path, 1 AS added, 1 AS removed FROM {part} GROUP BY ALL")
def diff_text(t: Tables) -> DataFrame:
    lines = F.split("diff", "\n")
    starting = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark) & ~x.startswith(mark * 3)))
    return _diffs(t).select("file_path", starting("+").alias("added"), starting("-").alias("removed"))


@query("u09_diff_symbols", "SELECT 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c' AS file_path, 'p' || CAST(max(p_partkey) AS VARCHAR) || '()' AS modifies, 'changed' AS calls FROM {part} GROUP BY p_partkey // 20")
def diff_symbols(t: Tables) -> DataFrame:
    rows = diffs.diff_hunks(_diffs(t).select(F.col("file_path").alias("git_sha"), "diff"))
    return rows.select("file_path", "modifies", F.array_join(F.filter("calls", lambda c: c != "p1"), "|").alias("calls"))


@query("u11_diffinfo", "SELECT 'p' || CAST(max(p_partkey) AS VARCHAR) AS modified, (SELECT count(DISTINCT caller) FROM {edges} e WHERE e.callee = CAST(max(p_partkey) AS VARCHAR)) AS callers FROM {part} GROUP BY p_partkey // 20")
def diffinfo(t: Tables) -> DataFrame:
    rows = diffs.diff_hunks(_diffs(t).select(F.col("file_path").alias("git_sha"), "diff"))
    modified = rows.select(F.regexp_replace("modifies", r"\(\)$", "").alias("modified")).distinct()
    edges = graph.call_edges(code.functions_of(code.extract_sources(_sources(t)))).distinct()
    return modified.join(edges, F.col("callee") == F.col("modified"), "left").groupBy("modified").agg(F.count("caller").alias("callers"))


def _raw(t: Tables) -> DataFrame:
    date = F.date_format(F.timestamp_seconds(F.lit(1578304800) + F.col("turn")), "EEE, d MMM yyyy HH:mm:ss")
    head = F.concat(F.lit("From: Some One <"), "role", F.lit("@x.org>\nTo: list@x.org\nDate: "), date, F.lit(" +0000\nSubject: a\n folded "), F.col("conv_id").cast("string"), F.lit("\nMessage-ID: <"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@x>\n\n"))
    return t.conversations.select(F.sha1(F.col("conv_id").cast("string").cast("binary")).alias("git_commit_sha"), F.concat(head, "text").alias("raw"))


@query("o08_mail_scan", "SELECT '<' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '@x>' AS message_id, 'a folded ' || CAST(conv_id AS VARCHAR) AS subject, 1578304800 + turn AS date_timestamp, text AS body FROM {conversations}")
def mail_scan(t: Tables) -> DataFrame:
    return parse_mails(_raw(t)).select("message_id", "subject", "date_timestamp", "body")


_AT = "make_timestamp(CAST((1578304800 + turn) * 1000000 AS BIGINT))"
_DAY = f"CAST(day({_AT}) AS VARCHAR)"


@query(
    "o11_mbox",
    f"SELECT conv_id, turn, 'From ' || role || '@x.org ' || strftime({_AT}, '%a %b ') || lpad({_DAY}, 2, ' ') || strftime({_AT}, ' %H:%M:%S %Y') || chr(10) || 'From: Some One <' || role || '@x.org>' || chr(10) || 'Date: ' || strftime({_AT}, '%a, ') || {_DAY} || strftime({_AT}, ' %b %Y %H:%M:%S +0000') || chr(10) || 'Message-ID: <' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '@x>' || chr(10) || 'To: list@x.org' || chr(10) || 'Subject: a folded ' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || text || chr(10) AS entry FROM {{conversations}}",
)
def mbox(t: Tables) -> DataFrame:
    """Whole entries of the mailbox."""
    ids = F.regexp_extract("value", r"\nMessage-ID: <(\d+)\.(\d+)@x>\n", 1), F.regexp_extract("value", r"\nMessage-ID: <(\d+)\.(\d+)@x>\n", 2)
    return mbox_lines(parse_mails(_raw(t))).select(ids[0].cast("bigint").alias("conv_id"), ids[1].cast("bigint").alias("turn"), F.col("value").alias("entry"))


@query("u13_mail_symbols", "SELECT 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c' AS file_path, 'p' || CAST(max(p_partkey) AS VARCHAR) || '()' AS symbols FROM {part} GROUP BY p_partkey // 20")
def mail_symbols(t: Tables) -> DataFrame:
    found = F.pandas_udf(lambda s: s.map(lambda x: diffs.symbols_of_diff(x or "")), "array<string>")
    return _diffs(t).select("file_path", F.array_join(found(F.concat(F.lit("Hello,\n\n"), "diff")), "|").alias("symbols"))


@query(
    "s07_base64_body",
    # 57 bytes make a full line; it takes two of them and a third, so that up to 114 bytes stay as they came.
    "SELECT doc_id, CASE WHEN strlen(text) > 114 THEN text ELSE regexp_replace(to_base64(encode(text)), '(.{{76}})', '\\1' || chr(10), 'g') END AS body FROM {documents}",
)
def base64_body(t: Tables) -> DataFrame:
    encoded = F.regexp_replace(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""), "(.{76})", "$1\n")
    return t.documents.select("doc_id", text.decode_base64_body(encoded).alias("body"))


@query("s08_snip_quotes", "SELECT doc_id, 'answer' || chr(10) || repeat('> q' || chr(10), 6) || '[...]' AS body FROM {documents}")
def snip(t: Tables) -> DataFrame:
    shorten = F.pandas_udf(lambda s: s.map(lambda x: snip_quotes(x or "")), "string")
    return t.documents.select("doc_id", shorten(F.concat(F.lit("answer\n"), F.repeat(F.lit("> q\n"), 19), F.lit("> q"))).alias("body"))


@query("s09_headers", "SELECT conv_id, turn, 'From: ' || role || chr(10) || 'Message-ID: <1>' || chr(10) || 'Subject: s' AS headers FROM {conversations}")
def headers(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return t.conversations.select("conv_id", "turn", text.headers(F.col("role"), none, F.lit("<1>"), F.lit("s"), F.lit(""), none).alias("headers"))


@query("u06_parameters", "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS name, pos, CASE pos WHEN 0 THEN 's' ELSE 'n' END AS parameter, CASE pos WHEN 0 THEN 'struct part *' ELSE 'unsigned int' END AS type_name FROM {part}, (SELECT unnest([0, 1]) AS pos) k")
def parameters(t: Tables) -> DataFrame:
    found = code.extract_sources(_sources(t)).where("kind = 'function'")
    return found.select("name", F.posexplode("parameters").alias("pos", "p")).select("name", "pos", F.col("p.name").alias("parameter"), F.col("p.type_name").alias("type_name"))


@query("u08_walk_back", "SELECT 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c' AS file_path, 'p' || CAST(max(p_partkey) AS VARCHAR) || '()' AS last_symbol, 'struct part' || CAST(p_partkey // 20 AS VARCHAR) AS second_line FROM {part} GROUP BY p_partkey // 20")
def walk_back(t: Tables) -> DataFrame:
    def at(lines: list[str], i: int) -> str:
        found = diffs.walk_back(lines, i)
        return diffs.symbol(*found) if found else ""

    last = F.pandas_udf(lambda s: s.map(lambda c: at(c.rstrip("}\n").split("\n"), 10**9)), "string")
    second = F.pandas_udf(lambda s: s.map(lambda c: at(c.split("\n"), 1)), "string")
    return _sources(t).select("file_path", last("content").alias("last_symbol"), second("content").alias("second_line"))


@query("u10_hunks", "SELECT 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c' AS file_path, 0 AS hunk, 'p' || CAST(max(p_partkey) AS VARCHAR) || '()' AS modifies FROM {part} GROUP BY p_partkey // 20")
def hunks(t: Tables) -> DataFrame:
    rows = diffs.diff_hunks(_diffs(t).select(F.col("file_path").alias("git_sha"), "diff"))
    return rows.select("file_path", "hunk", "modifies")


@query("o10_json_rows", "SELECT name, file_path, 'int' AS return_type, 2 AS n FROM (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS name, 'src/f' || CAST(p_partkey // 20 AS VARCHAR) || '.c' AS file_path FROM {part}) x")
def json_rows(t: Tables) -> DataFrame:
    """The lines that the JSON sink writes, read again."""
    found = code.functions_of(code.extract_sources(_sources(t))).where("return_type <> ''")
    line = F.to_json(F.struct(*(c for c in found.columns if c != "body")))
    back = F.from_json(line, "name string, file_path string, return_type string, parameters array<struct<name:string>>")
    return found.select(back.alias("j")).select("j.name", "j.file_path", "j.return_type", F.size("j.parameters").alias("n"))


@query("s04_date_phrases", "SELECT * FROM (VALUES ('yesterday', '2024-03-30'), ('7 days ago', '2024-03-24'), ('1 month ago', '2024-02-29'), ('2024-11-13', '2024-11-13')) v(phrase, day)")
def date_phrases(t: Tables) -> DataFrame:
    from datetime import datetime, timezone

    from ..functions.dates import parse_date

    now = datetime(2024, 3, 31, 12, tzinfo=timezone.utc)
    phrases = ("yesterday", "7 days ago", "1 month ago", "2024-11-13")
    return t.spark.createDataFrame([(p, parse_date(p, now).date().isoformat()) for p in phrases], "phrase string, day string")
