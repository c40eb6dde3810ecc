"""Registered queries over the driver's tables, and the tables that stand in for a code store.

The driver has no source code, so functions, types, commits, mails and manifests
are derived from its tables by SQL that Spark and DuckDB both read.  A query gets
them lazily from :class:`Tables`; its oracle gets them as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_NAME = "replace(p_name, ' ', '_')"
_BODY = f"CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN {_NAME} || '(void);' ELSE {_NAME} || '(int a) {{{{' || chr(10) || repeat('  step(a, ' || p_brand || ');' || chr(10), p_size % 7) || '  return ' || lower(p_type) || ';' || chr(10) || '}}}}' END"
_PATH = "'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || CASE p_partkey % 4 WHEN 0 THEN '.h' WHEN 1 THEN '.rs' ELSE '.c' END"

#: Derived tables; what they read stands in braces.
DERIVED: dict[str, str] = {
    "functions": f"SELECT p_partkey AS id, {_NAME} AS name, {_PATH} AS file_path, sha1(p_brand || p_type || CAST(p_partkey % 3 AS STRING)) AS git_file_hash, CAST(p_size * 10 AS BIGINT) AS line_start, CAST(p_size * 10 + p_partkey % 60 AS BIGINT) AS line_end, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE lower(p_type) END AS return_type, CAST(p_partkey % 4 AS INT) AS n_params, {_BODY} AS body, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE sha1({_BODY}) END AS body_hash FROM {{part}}",
    "types": "SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_t' AS name, 'include/' || replace(lower(p_brand), '#', '') || '.h' AS file_path, sha1(p_brand || CAST(p_partkey % 2 AS STRING)) AS git_file_hash, CAST(p_size AS BIGINT) AS line, CASE p_partkey % 4 WHEN 0 THEN 'struct' WHEN 1 THEN 'union' WHEN 2 THEN 'enum' ELSE 'typedef' END AS kind, CAST(p_partkey % 5 AS INT) AS n_fields, 'struct ' || p_name || ' {{ ' || repeat('int x; ', p_size % 9) || '}}' AS definition FROM {part}",
    "content": "SELECT hash, max(content) AS content FROM (SELECT sha1(body) AS hash, body AS content FROM {functions} WHERE body <> '') c GROUP BY hash",
    "manifest": "SELECT file_path, max(git_file_hash) AS git_file_hash FROM {functions} WHERE id % 7 <> 3 GROUP BY file_path",
    "old_manifest": "SELECT CASE WHEN id % 10 = 0 THEN 'old/' || file_path ELSE file_path END AS file_path, min(git_file_hash) AS git_file_hash FROM {functions} WHERE id % 5 <> 1 GROUP BY 1",
    "touched": "SELECT DISTINCT file_path FROM {functions} WHERE id % 23 = 0",
    "overlay": "SELECT id, upper(substr(name, 1, 1)) || substr(name, 2) AS name, file_path, 'workdir' AS git_file_hash, line_start, line_end, return_type, n_params, body || ' /* edited */' AS body, body_hash FROM {functions} WHERE id % 23 = 0",
    "symbols": "SELECT DISTINCT name AS symbol, file_path AS filename FROM {functions} WHERE id % 3 <> 0",
    "edges": "SELECT CAST(p_partkey AS STRING) AS caller, CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS callee FROM {part} WHERE p_partkey >= 2 UNION ALL SELECT CAST(p_partkey AS STRING), CAST(1 + (p_partkey * 7 + 3) % (SELECT count(*) FROM {part}) AS STRING) FROM {part} WHERE p_size % 5 = 0",
    "commits": "SELECT sha1(CAST(o_orderkey AS STRING)) AS git_sha, o_orderkey AS n, c_name AS author, o_orderpriority || ' fix ' || CAST(o_orderkey % 100 AS STRING) AS subject, o_orderpriority || chr(10) || chr(10) || 'Reviewed-by: ' || c_name || chr(10) || 'Cc: list ' || CAST(o_orderkey % 7 AS STRING) || chr(10) || 'Cc: maintainer' || chr(10) || 'not-a-tag: x' AS message, 'diff of ' || CAST(o_orderkey % 13 AS STRING) AS diff, CAST(o_orderdate AS DATE) AS day FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "commit_files": "SELECT sha1(CAST(l_orderkey AS STRING)) AS git_sha, 'dir' || CAST(l_suppkey % 10 AS STRING) || '/f' || CAST(l_partkey AS STRING) || '.c' AS file FROM {lineitem}",
    "parents": "SELECT child, parent FROM (SELECT o_orderkey AS child, CAST(floor(o_orderkey / 2) AS BIGINT) AS parent FROM {orders} WHERE o_orderkey >= 1 UNION ALL SELECT o_orderkey, o_orderkey - 1 FROM {orders} WHERE o_orderkey % 10 = 0 AND o_orderkey >= 1) p",
    "mails": "SELECT '<' || CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) || '@list>' AS message_id, CASE WHEN turn > 0 THEN '<' || CAST(conv_id AS STRING) || ':' || CAST(turn - 1 - (conv_id % 2) * (turn % 2) * CASE WHEN turn > 1 THEN 1 ELSE 0 END AS STRING) || '@list>' END AS in_reply_to, '' AS references, role AS sender, CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END || 'topic ' || CAST(conv_id % 50 AS STRING) AS subject, text AS body, 'list' || CAST(conv_id % 4 AS STRING) || '@example.org' AS recipients, CAST(1600000000 + conv_id * 5000 - turn * 70 AS BIGINT) AS date_timestamp, conv_id, turn FROM {conversations}",
    "looped_mails": "SELECT message_id, CASE WHEN turn = 0 AND conv_id % 17 = 5 THEN '<' || CAST(conv_id AS STRING) || ':1@list>' ELSE in_reply_to END AS in_reply_to, date_timestamp, conv_id, turn FROM {mails}",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
}

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _needs(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql.replace("{{", "").replace("}}", ""))


class Tables:
    """The base and derived tables of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = DERIVED[name]
                self._made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in set(_needs(sql))})
        return self._made[name]


def _with(sql: str) -> str:
    """``sql`` in DuckDB, with the derived tables it names in braces before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in order:
            for other in _needs(DERIVED[name]):
                visit(other)
            order.append(name)

    for name in _needs(sql):
        visit(name)
    plain = {n: n for n in (*BASE, *DERIVED)} | {"mails": "mails"}
    parts = [f"{n} AS ({DERIVED[n].format(**plain).replace(' AS references', ' AS "references"')})" for n in order]
    body = sql.format(**plain).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(parts) + " " + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its equivalent for DuckDB."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = _with(sql)
        return f

    return register


def run(f: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))
