"""Scans, lookups, picks, grep and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grep, lookup, ranking, storage
from .base import Tables, query

_ROW = "id, name, file_path, git_file_hash, line_start, line_end"
_COLS = _ROW.split(", ")
_HERE = "SELECT f.* FROM {functions} f WHERE EXISTS (SELECT 1 FROM {manifest} m WHERE m.file_path = f.file_path AND m.git_file_hash = f.git_file_hash)"


def _row(df: DataFrame) -> DataFrame:
    return df.select(*_COLS)


@query("o01_full_scan", f"SELECT {_ROW}, return_type, body FROM {{functions}}")
def full_scan(t: Tables) -> DataFrame:
    return t.functions.select(*_COLS, "return_type", "body")


@query("o02_paged_scan", f"SELECT {_ROW} FROM {{functions}} ORDER BY id LIMIT 100 OFFSET 200")
def paged_scan(t: Tables) -> DataFrame:
    return _row(storage.page(t.functions, [F.col("id")], 3, 100))


@query("o03_projection", "SELECT name, body_hash FROM {functions} WHERE body_hash IS NOT NULL")
def projection(t: Tables) -> DataFrame:
    return t.functions.where("body_hash IS NOT NULL").select("name", "body_hash")


@query("o04_count_rows", "SELECT 'functions' AS table_name, count(*) AS n FROM {functions} UNION ALL SELECT 'types', count(*) FROM {types} UNION ALL SELECT 'typedefs', count(*) FROM {types} WHERE kind = 'typedef'")
def count_rows(t: Tables) -> DataFrame:
    return storage.table_statistics({"functions": t.functions, "types": t.types, "typedefs": t.types.where("kind = 'typedef'")})


@query("o12_regex_functions", f"SELECT {_ROW} FROM {{functions}} WHERE regexp_matches(name, '^(red|blue)_.*t$')")
def regex_functions(t: Tables) -> DataFrame:
    return _row(lookup.by_regex(t.functions, "^(red|blue)_.*t$"))


@query("o13_regex_types", "SELECT id, name, kind FROM {types} WHERE regexp_matches(name, 'ring') UNION ALL SELECT id, name, 'typedef only' FROM {types} WHERE regexp_matches(name, 'bolt') AND kind = 'typedef'")
def regex_types(t: Tables) -> DataFrame:
    typedefs = lookup.by_regex(t.types.where("kind = 'typedef'"), "bolt")
    return lookup.by_regex(t.types, "ring").select("id", "name", "kind").unionByName(typedefs.select("id", "name", F.lit("typedef only").alias("kind")))


@query("o14_regex_at_commit", f"WITH here AS ({_HERE}) SELECT {_ROW} FROM here WHERE regexp_matches(name, 'RED_', 'i') AND file_path NOT IN (SELECT file_path FROM {{touched}}) UNION ALL SELECT {_ROW} FROM {{overlay}} WHERE regexp_matches(name, 'RED_', 'i')")
def regex_at_commit(t: Tables) -> DataFrame:
    return _row(lookup.by_regex_at(t.functions, t.manifest, "RED_", False, t.overlay, t.touched))


@query("o15_exact_name", f"SELECT {_ROW} FROM {{functions}} WHERE name = 'red_widget'")
def exact_name(t: Tables) -> DataFrame:
    return _row(lookup.exact(t.functions, "red_widget"))


@query(
    "o16_prefer_definitions",
    f"WITH f AS (SELECT *, strlen(body) > 100 AND line_end > line_start AS d FROM {{functions}} WHERE name = 'blue_bolt') SELECT {_ROW} FROM f WHERE d = (SELECT bool_or(d) FROM f)",
)
def prefer_definitions(t: Tables) -> DataFrame:
    return _row(lookup.exact_preferring_definitions(t.functions, "blue_bolt"))


_FUZZY = "SELECT {row} FROM {source} WHERE name = '{name}' OR (contains(name, '{name}') AND NOT EXISTS (SELECT 1 FROM {source} WHERE name = '{name}')) ORDER BY id LIMIT 100"


@query("o17_fuzzy_substring", _FUZZY.format(row=_ROW, source="{functions}", name="widg"))
def fuzzy_substring(t: Tables) -> DataFrame:
    return _row(lookup.fuzzy(t.functions, "widg", ["id"]))


@query("o17_fuzzy_exact", _FUZZY.format(row=_ROW, source="{functions}", name="red_widget"))
def fuzzy_exact(t: Tables) -> DataFrame:
    return _row(lookup.fuzzy(t.functions, "red_widget", ["id"]))


@query("o17_fuzzy_types", _FUZZY.format(row="id, name, kind", source="{types}", name="ring"))
def fuzzy_types(t: Tables) -> DataFrame:
    return lookup.fuzzy(t.types, "ring", ["id"]).select("id", "name", "kind")


@query("o18_fuzzy_at_commit", f"WITH here AS ({_HERE}) " + _FUZZY.format(row=_ROW, source="here", name="bolt"))
def fuzzy_at_commit(t: Tables) -> DataFrame:
    return _row(lookup.fuzzy_at(t.functions, t.manifest, "bolt", ["id"]))


@query("o19_kind", "SELECT id, name, kind FROM {types} WHERE kind = 'union' ORDER BY id LIMIT 100")
def kind(t: Tables) -> DataFrame:
    return lookup.by_kind(t.types, "union", ["id"]).select("id", "name", "kind")


_GREP = f"SELECT {_ROW} FROM {{functions}} WHERE regexp_matches(body, 'step\\(a, Brand#1[0-9]\\)')"


@query("o20_grep_bodies", _GREP + " AND regexp_matches(file_path, 'SRC/promo', 'i') ORDER BY id LIMIT 50")
def grep_bodies(t: Tables) -> DataFrame:
    found = grep.grep_bodies(t.functions, t.content, r"step\(a, Brand#1[0-9]\)", "SRC/promo")
    return _row(found.orderBy("id").limit(50))


@query("o20_grep_limit_hit", "SELECT count(*) > 50 AS limit_hit FROM {functions} WHERE regexp_matches(body, 'return')")
def grep_limit_hit(t: Tables) -> DataFrame:
    return storage.with_limit_flag(grep.grep_bodies(t.functions, t.content, "return"), [F.col("id")], 50)[1]


@query(
    "o21_grep_at_commit",
    f"WITH here AS ({_HERE}) SELECT {_ROW} FROM here WHERE regexp_matches(body, 'return small') AND file_path NOT IN (SELECT file_path FROM {{touched}}) UNION ALL SELECT {_ROW} FROM {{overlay}} WHERE regexp_matches(body, 'return small', 'i')",
)
def grep_at_commit(t: Tables) -> DataFrame:
    return _row(grep.grep_bodies_at(t.functions, t.content, t.manifest, "return small", t.overlay, t.touched))


@query(
    "o22_matching_lines",
    "WITH l AS (SELECT name, file_path, line_start, unnest(string_split(body, chr(10))) AS content, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM {functions}) SELECT name, file_path, line_start + pos AS line, content FROM l WHERE regexp_matches(content, 'return (large|medium)')",
)
def matching_lines(t: Tables) -> DataFrame:
    return grep.matching_lines(t.functions, "return (large|medium)")


@query("o23_path_filter", f"SELECT {_ROW} FROM {{functions}} WHERE regexp_matches(file_path, '^src/(economy|small)/.*\\.rs$')")
def path_filter(t: Tables) -> DataFrame:
    return _row(t.functions.where(lookup.matching(r"^src/(economy|small)/.*\.rs$", True, "file_path")))


@query("o37_existence", "SELECT n.doc_id, EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = n.doc_id) AS present FROM (SELECT DISTINCT doc_id FROM {documents}) n")
def existence(t: Tables) -> DataFrame:
    return lookup.exists_by(t.labels, t.documents.select("doc_id").distinct(), ["doc_id"])


@query("o38_line_range", "SELECT id, line_start, line_end, line_end - line_start AS extent FROM {functions} WHERE line_start >= 100 AND line_end <= 300")
def line_range(t: Tables) -> DataFrame:
    return lookup.lines_between(t.functions, 100, 300).select("id", "line_start", "line_end", "extent")


@query("o39_batch_by_names", f"SELECT {_ROW} FROM {{functions}} WHERE name IN (SELECT name FROM {{functions}} WHERE id < 20) QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path DESC, git_file_hash DESC, line_start DESC, id) = 1")
def batch_by_names(t: Tables) -> DataFrame:
    unique = ranking.top_one(t.functions, ["name", "file_path", "git_file_hash", "line_start"], [F.col("id")])
    return _row(lookup.by_names(unique, t.functions.where("id < 20")))


@query("o40_by_blobs", f"SELECT {_ROW} FROM {{functions}} f WHERE EXISTS (SELECT 1 FROM {{old_manifest}} m WHERE m.file_path = f.file_path AND m.git_file_hash = f.git_file_hash)")
def by_blobs(t: Tables) -> DataFrame:
    return _row(lookup.by_blobs(t.functions, t.old_manifest))


@query("o41_manifest_join", f"SELECT {_ROW} FROM ({_HERE}) here")
def manifest_join(t: Tables) -> DataFrame:
    return _row(lookup.at_commit(t.functions, t.manifest))


@query("o42_resolve_content", "SELECT f.id, f.name, coalesce(c.content, '') AS body FROM {functions} f LEFT JOIN {content} c ON f.body_hash = c.hash")
def resolve_content(t: Tables) -> DataFrame:
    return storage.resolve_content(t.functions.drop("body"), t.content, "body_hash").select("id", "name", "body")


@query(
    "o43_symbol_to_rows",
    f"WITH hits AS (SELECT f.*, EXISTS (SELECT 1 FROM {{manifest}} m JOIN {{symbols}} s ON s.filename = m.file_path WHERE s.symbol = 'red_widget' AND m.file_path = f.file_path AND m.git_file_hash = f.git_file_hash) AS here FROM {{functions}} f WHERE name = 'red_widget') SELECT {_ROW} FROM hits WHERE here OR NOT EXISTS (SELECT 1 FROM hits WHERE here)",
)
def symbol_to_rows(t: Tables) -> DataFrame:
    return _row(lookup.through_symbols("red_widget", t.symbols, t.manifest, t.functions))


@query("o45_overlay_merge", f"SELECT {_ROW} FROM {{functions}} WHERE file_path NOT IN (SELECT file_path FROM {{touched}}) UNION ALL SELECT {_ROW} FROM {{overlay}}")
def overlay_merge(t: Tables) -> DataFrame:
    return _row(lookup.with_overlay(t.functions, t.overlay, t.touched))


@query("o45b_missing_keys", "SELECT doc_id, lang FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
def missing_keys(t: Tables) -> DataFrame:
    return storage.missing_keys(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


_REAL = "(line_end > line_start AND strlen(body) > 50)"


@query("o46_best_definition", f"SELECT {_ROW} FROM {{functions}} QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path LIKE '%.c' DESC, {_REAL} DESC, n_params > 0 DESC, strlen(body) DESC, file_path, git_file_hash, line_start, id) = 1")
def best_definition(t: Tables) -> DataFrame:
    return _row(ranking.best_definition(t.functions, ("id",)))


@query("o47_best_by_extent", f"SELECT {_ROW} FROM {{functions}} QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path LIKE '%.h', line_end - line_start DESC, file_path, git_file_hash, line_start, id) = 1")
def best_by_extent(t: Tables) -> DataFrame:
    return _row(ranking.best_by_extent(ranking.top_one(t.functions, ["name", "file_path", "git_file_hash", "line_start", "line_end"], [F.col("id")])))


@query("o48_best_overlay", "SELECT name, file_path FROM {overlay} QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path LIKE '%.c' DESC, strlen(body) DESC, file_path, git_file_hash, line_start, id) = 1")
def best_overlay(t: Tables) -> DataFrame:
    return ranking.best_overlay(t.overlay).select("name", "file_path")


@query("o49_implementations", f"SELECT {_ROW} FROM {{functions}} WHERE return_type = '' OR (strlen(body) > 50 AND NOT (line_end - line_start <= 1 AND trim(body) LIKE '%;'))")
def implementations(t: Tables) -> DataFrame:
    return _row(ranking.implementations(t.functions))


@query(
    "o50_definition_test",
    "SELECT id, CASE WHEN trim(body) = '' THEN false WHEN return_type = '' THEN true WHEN trim(body) LIKE '%;' AND NOT contains(body, '{{') THEN false WHEN contains(body, '{{') AND contains(body, '}}') THEN true WHEN regexp_matches(file_path, '\\.(h|hpp)$') THEN false ELSE NOT trim(body) LIKE '%;' END AS definition FROM {functions}",
)
def definition_test(t: Tables) -> DataFrame:
    return t.functions.select("id", ranking.is_definition().alias("definition"))


@query("o51_dedup_in_file", "SELECT name, file_path, git_file_hash, line_start FROM {functions} QUALIFY row_number() OVER (PARTITION BY file_path, git_file_hash, name ORDER BY (strlen(body) > 0 AND n_params > 0) DESC, line_end - line_start DESC, strlen(body) DESC, n_params DESC, line_start) = 1")
def dedup_in_file(t: Tables) -> DataFrame:
    return ranking.dedup_in_file(t.functions).select("name", "file_path", "git_file_hash", "line_start")


@query("o52_dedup_types_in_file", "SELECT name, kind, file_path, git_file_hash, n_fields, line FROM {types} QUALIFY row_number() OVER (PARTITION BY file_path, git_file_hash, name, kind ORDER BY n_fields DESC, strlen(definition) DESC, line) = 1")
def dedup_types_in_file(t: Tables) -> DataFrame:
    return ranking.dedup_types_in_file(t.types).select("name", "kind", "file_path", "git_file_hash", "n_fields", "line")


@query("o53_last_wins", "SELECT sha1(text) AS hash, max(doc_id) AS doc_id FROM {documents} GROUP BY 1")
def last_wins(t: Tables) -> DataFrame:
    return ranking.last_wins(t.documents.select(F.sha1(F.col("text").cast("binary")).alias("hash"), "doc_id"), ["hash"], "doc_id")


@query("o54_upsert", "SELECT doc_id, lang, source FROM {documents} WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, upper(lang), 'new' FROM {documents} WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1000000000, lang, 'added' FROM {documents} WHERE doc_id % 50 = 0")
def upsert(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", "lang", "source")
    new = old.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit("new").alias("source"))
    added = old.where("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "lang", F.lit("added").alias("source"))
    return storage.upsert(old, new.unionByName(added), ["doc_id"])


@query("o55_delete", "SELECT doc_id, lang FROM {documents} WHERE NOT (lang = 'de' AND source = 'src3')")
def delete(t: Tables) -> DataFrame:
    return storage.delete_where(t.documents, (F.col("lang") == "de") & (F.col("source") == "src3")).select("doc_id", "lang")


@query("o56_duplicate_report", "WITH g AS (SELECT text, lang, count(*) AS c FROM {documents} GROUP BY ALL) SELECT CAST(sum(c) AS BIGINT) AS total_rows, count(*) FILTER (c > 1) AS duplicate_groups, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS rows_in_groups FROM g")
def duplicate_report(t: Tables) -> DataFrame:
    return storage.duplicate_report(t.documents.select("text", "lang"))


@query("o60_shard_statistics", "SELECT CAST(strpos('0123456789abcdef', substr(hash, 1, 1)) - 1 AS INT) AS shard, count(*) AS entries, CAST(sum(strlen(content)) AS BIGINT) AS bytes, avg(strlen(content)) AS mean_bytes FROM (SELECT sha1(text) AS hash, max(text) AS content FROM {documents} WHERE text <> '' GROUP BY 1) c GROUP BY 1")
def shard_statistics(t: Tables) -> DataFrame:
    return storage.shard_statistics(storage.content_store(t.documents, "text"))


@query("o61_content_usage", "SELECT hash, count(*) AS uses FROM (SELECT body_hash AS hash FROM {functions} UNION ALL SELECT sha1(definition) FROM {types}) u WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1")
def content_usage(t: Tables) -> DataFrame:
    return storage.content_usage({"functions": t.functions.select(F.col("body_hash").alias("hash")), "types": t.types.select(F.sha1(F.col("definition").cast("binary")).alias("hash"))})


@query("o65_limit_with_flag", "SELECT id, name FROM {functions} ORDER BY line_end DESC, id LIMIT 25")
def limit_with_flag(t: Tables) -> DataFrame:
    return storage.with_limit_flag(t.functions, [F.desc("line_end"), F.col("id")], 25)[0].select("id", "name")


@query(
    "o66_pagination",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {documents}) SELECT doc_id, CAST(floor((line - 1) / 50) + 1 AS INT) AS page, CAST(line AS INT) AS line, content FROM l",
)
def pagination(t: Tables) -> DataFrame:
    return storage.paged_lines(t.documents)


@query("o76_shard_function", "SELECT doc_id, CAST(strpos('0123456789abcdef', substr(sha1(text), 1, 1)) - 1 AS INT) AS shard FROM {documents}")
def shard_function(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", storage.shard_of(F.sha1(F.col("text").cast("binary"))).alias("shard"))


@query("o77_content_store", "SELECT sha1(text) AS hash, max(text) AS content, CAST(strpos('0123456789abcdef', substr(sha1(text), 1, 1)) - 1 AS INT) AS shard FROM {documents} WHERE text <> '' GROUP BY 1, 3")
def content_store(t: Tables) -> DataFrame:
    return storage.content_store(t.documents, "text")


@query("o78_symbol_table", "SELECT name AS symbol, file_path AS filename FROM {functions} UNION SELECT name, file_path FROM {types}")
def symbol_table(t: Tables) -> DataFrame:
    return storage.symbol_table(t.functions, t.types)


@query("o79_set_operations", "SELECT 'union' AS op, doc_id FROM (SELECT doc_id FROM {documents} WHERE lang = 'en' UNION SELECT doc_id FROM {documents} WHERE source = 'src1') a UNION ALL SELECT 'intersect', doc_id FROM (SELECT doc_id FROM {documents} WHERE lang = 'en' INTERSECT SELECT doc_id FROM {documents} WHERE source = 'src1') b UNION ALL SELECT 'except', doc_id FROM (SELECT doc_id FROM {documents} WHERE lang = 'en' EXCEPT SELECT doc_id FROM {documents} WHERE source = 'src1') c")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.documents.where("lang = 'en'").select("doc_id"), t.documents.where("source = 'src1'").select("doc_id")
    label = lambda op, df: df.select(F.lit(op).alias("op"), "doc_id")
    return label("union", a.union(b).distinct()).unionByName(label("intersect", a.intersect(b))).unionByName(label("except", a.subtract(b)))


@query("o80_verb_exact", "SELECT DISTINCT 0 AS tier, name FROM {types} WHERE name = 'red_widget_t'")
def verb_exact(t: Tables) -> DataFrame:
    return lookup.named_or_like(t.types, "struct red_widget_t")


@query("o80_verb_regex", "SELECT DISTINCT 1 AS tier, name FROM {types} WHERE regexp_matches(name, 'RING_t', 'i')")
def verb_regex(t: Tables) -> DataFrame:
    return lookup.named_or_like(t.types, "RING_t")


@query("o80_verb_suggestions", "SELECT 2 AS tier, name FROM (SELECT DISTINCT name FROM {types}) n WHERE levenshtein(name, 'red_wigdet_t') <= 4 ORDER BY levenshtein(name, 'red_wigdet_t'), name LIMIT 3")
def verb_suggestions(t: Tables) -> DataFrame:
    return lookup.named_or_like(t.types, "red_wigdet_t")
