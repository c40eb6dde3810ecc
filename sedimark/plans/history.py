"""Graphs, commits and mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commits, graph, mail, ranking, storage
from ..functions import text
from .base import Tables, query


def _functions(t: Tables) -> DataFrame:
    """The derived call graph as rows with a list of calls."""
    return t.edges.groupBy(F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("calls"))


def _named(t: Tables, *names: str) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in names], "name string")


_UNIQUE = "(SELECT DISTINCT caller, callee FROM {edges})"


@query("o57_caller_index", "SELECT callee, list_sort(list(caller)) AS callers FROM {edges} GROUP BY callee")
def caller_index(t: Tables) -> DataFrame:
    return graph.caller_index(t.edges)


@query("o58_call_edges", "SELECT DISTINCT caller, callee FROM {edges}")
def call_edges(t: Tables) -> DataFrame:
    return graph.call_edges(_functions(t))


@query("o59_entry_points", "SELECT DISTINCT caller AS name FROM {edges} WHERE caller NOT IN (SELECT callee FROM {edges})")
def entry_points(t: Tables) -> DataFrame:
    return graph.entry_points(t.edges)


@query("o67_callers", "SELECT DISTINCT caller AS name FROM {edges} WHERE callee = '7'")
def callers(t: Tables) -> DataFrame:
    return graph.callers(_functions(t), "7")


@query("o68_callees", "SELECT DISTINCT callee FROM {edges} WHERE caller = '95'")
def callees(t: Tables) -> DataFrame:
    return graph.callees(_functions(t), "95")


def _levels(start: str, depth: int, a: str, b: str) -> str:
    return f"w(name, level) AS (SELECT '{start}', 0 UNION SELECT e.{b}, level + 1 FROM w JOIN {{edges}} e ON e.{a} = w.name WHERE level < {depth}), l AS (SELECT name, min(level) AS level FROM w GROUP BY name)"


@query("o69_closure_forward", f"WITH RECURSIVE {_levels('95', 6, 'caller', 'callee')} SELECT DISTINCT caller, callee FROM {{edges}} JOIN l ON caller = name WHERE level < 6")
def closure_forward(t: Tables) -> DataFrame:
    return graph.closure(t.edges, _named(t, "95"), 6)


@query("o69_closure_backward", f"WITH RECURSIVE {_levels('3', 5, 'callee', 'caller')} SELECT DISTINCT caller, callee FROM {{edges}} JOIN l ON callee = name WHERE level < 5")
def closure_backward(t: Tables) -> DataFrame:
    return graph.closure(t.edges, _named(t, "3"), 5, "backward")


_BOTH = "s AS (SELECT DISTINCT caller AS a, callee AS b FROM {edges} UNION SELECT callee, caller FROM {edges})"


@query(
    "o69_closure_both",
    f"WITH RECURSIVE {_BOTH}, w(name, level) AS (SELECT '95', 0 UNION SELECT b, level + 1 FROM w JOIN s ON a = name WHERE level < 3), l AS (SELECT name, min(level) AS level FROM w GROUP BY name) SELECT DISTINCT caller, callee FROM {{edges}} WHERE caller IN (SELECT name FROM l WHERE level < 3) OR callee IN (SELECT name FROM l WHERE level < 3)",
)
def closure_both(t: Tables) -> DataFrame:
    return graph.closure(t.edges, _named(t, "95"), 3, "both")


@query(
    "o70_call_tree",
    f"WITH RECURSIVE w(path, name, depth) AS (SELECT ['95'], '95', 0 UNION ALL SELECT list_append(path, callee), callee, depth + 1 FROM w JOIN {_UNIQUE} e ON caller = name WHERE depth < 3 AND NOT list_contains(path, callee)) SELECT path, name, depth FROM w",
)
def call_tree(t: Tables) -> DataFrame:
    return graph.tree(t.edges, _named(t, "95"), 3)


@query(
    "o70b_limited_chain",
    f"WITH one AS (SELECT DISTINCT caller AS first FROM {{edges}} WHERE callee = '3' ORDER BY 1 LIMIT 15), two AS (SELECT callee AS first, caller AS second FROM {_UNIQUE} e WHERE callee IN (SELECT first FROM one) QUALIFY row_number() OVER (PARTITION BY callee ORDER BY caller) <= 3) SELECT one.first, two.second FROM one LEFT JOIN two ON one.first = two.first",
)
def limited_chain(t: Tables) -> DataFrame:
    return graph.limited_chain(t.edges, _named(t, "3"), direction="backward")


@query("o70c_level_sets", f"WITH RECURSIVE {_levels('95', 8, 'caller', 'callee')} SELECT level, list_sort(list(name)) AS names FROM l GROUP BY level")
def level_sets(t: Tables) -> DataFrame:
    return graph.levels(t.edges, _named(t, "95"), 8).groupBy("level").agg(F.array_sort(F.collect_list("name")).alias("names"))


@query(
    "o70d_paths_to_target",
    """
    WITH RECURSIVE w(name, level) AS (SELECT '1', 0 UNION SELECT e.caller, level + 1 FROM w JOIN {edges} e ON e.callee = w.name WHERE level < 10),
    l AS (SELECT name, min(level) AS level FROM w GROUP BY name),
    hop AS (SELECT x.name, min(y.name) AS next FROM {edges} e JOIN l x ON e.caller = x.name JOIN l y ON e.callee = y.name WHERE y.level = x.level - 1 GROUP BY x.name),
    p(start, path, node) AS (SELECT name, [name], name FROM l WHERE name IN (SELECT caller FROM {edges} WHERE caller NOT IN (SELECT callee FROM {edges})) UNION ALL SELECT start, list_append(path, next), next FROM p JOIN hop ON hop.name = p.node WHERE p.node <> '1')
    SELECT start, path FROM p WHERE node = '1'
    """,
)
def paths_to_target(t: Tables) -> DataFrame:
    return graph.paths_to(t.edges, graph.entry_points(t.edges), "1")


@query(
    "o75b_connected_files",
    "WITH f AS (SELECT caller AS name, 'f' || CAST(CAST(caller AS BIGINT) % 300 AS VARCHAR) AS file_path, callee FROM {edges}), own AS (SELECT * FROM f WHERE file_path IN ('f1', 'f2')) SELECT 'f1' AS file_path UNION SELECT 'f2' UNION SELECT file_path FROM f WHERE name IN (SELECT callee FROM own) UNION SELECT file_path FROM f WHERE callee IN (SELECT name FROM own)",
)
def connected_files(t: Tables) -> DataFrame:
    rows = _functions(t).withColumn("file_path", F.concat(F.lit("f"), (F.col("name").cast("bigint") % 300).cast("string")))
    return graph.connected_files(rows, t.spark.createDataFrame([("f1",), ("f2",)], "file_path string"))


def _commits(t: Tables) -> DataFrame:
    files = t.commit_files.groupBy("git_sha").agg(F.array_sort(F.collect_set("file")).alias("files"))
    symbols = F.array(F.concat(F.lit("fn_"), (F.col("n") % 40).cast("string"), F.lit("()")), F.concat(F.lit("struct s"), (F.col("n") % 9).cast("string")))
    return t.commits.join(files, "git_sha", "left").withColumn("symbols", symbols)


_FILES = "EXISTS (SELECT 1 FROM {commit_files} f WHERE f.git_sha = c.git_sha AND regexp_matches(f.file, '%s', 'i'))"


@query("o24_author_subject", "SELECT git_sha FROM {commits} c WHERE (regexp_matches(author, 'customer#0000000[12]', 'i') OR regexp_matches(author, '99$', 'i')) AND (regexp_matches(subject, 'HIGH', 'i') OR regexp_matches(subject, 'fix 7', 'i'))")
def author_subject(t: Tables) -> DataFrame:
    return commits.filter_commits(t.commits, author=["customer#0000000[12]", "99$"], subject=["HIGH", "fix 7"]).select("git_sha")


@query("o25_message_diff", "SELECT git_sha FROM {commits} c WHERE regexp_matches(message || chr(10) || chr(10) || diff, 'list 3', 'i') AND regexp_matches(message || chr(10) || chr(10) || diff, 'DIFF OF 5', 'i')")
def message_diff(t: Tables) -> DataFrame:
    return commits.filter_commits(t.commits, text=["list 3", "DIFF OF 5"]).select("git_sha")


@query("o26_symbols", "SELECT git_sha FROM {commits} c WHERE n % 40 IN (3, 13, 23, 33) AND n % 9 = 4")
def symbols(t: Tables) -> DataFrame:
    return commits.filter_commits(_commits(t), symbol=[r"^fn_\d?3\(", "STRUCT s4"]).select("git_sha")


@query("o27_paths", "SELECT git_sha FROM {commits} c WHERE " + _FILES % "DIR3/f1" + " OR " + _FILES % "f77\\.c")
def paths(t: Tables) -> DataFrame:
    return commits.filter_commits(_commits(t), path=["DIR3/f1", r"f77\.c"]).select("git_sha")


_UP = "{name}(n) AS (SELECT CAST({start} AS BIGINT) UNION SELECT p.parent FROM {name} JOIN {{parents}} p ON p.child = {name}.n)"


def _up(name: str, start: int) -> str:
    return _UP.format(name=name, start=start)


def _start(t: Tables, n: int) -> DataFrame:
    return t.spark.createDataFrame([(n,)], "git_sha bigint")


@query("o28_combined_filter", f"WITH RECURSIVE {_up('a', 14000)} SELECT git_sha, n FROM {{commits}} c WHERE regexp_matches(author, '[0-4]$', 'i') AND regexp_matches(message, 'Cc', 'i') AND n IN (SELECT n FROM a) ORDER BY n LIMIT 50")
def combined_filter(t: Tables) -> DataFrame:
    reach = commits.ancestors(t.parents, _start(t, 14000)).withColumnRenamed("git_sha", "n")
    found = commits.filter_commits(t.commits, author=["[0-4]$"], text=["Cc"]).join(reach, "n", "left_semi")
    return found.orderBy("n").limit(50).select("git_sha", "n")


@query("o29_commit_range", f"WITH RECURSIVE {_up('a', 9000)}, {_up('b', 14990)} SELECT git_sha, n FROM {{commits}} WHERE n IN (SELECT n FROM b) AND n NOT IN (SELECT n FROM a) AND (regexp_matches(message, 'list', 'i') OR regexp_matches(diff, 'list', 'i'))")
def commit_range(t: Tables) -> DataFrame:
    chosen = commits.commit_range(t.parents, _start(t, 9000), _start(t, 14990)).withColumnRenamed("git_sha", "n")
    return commits.filter_commits(t.commits, text=["list"], separately=True).join(chosen, "n", "left_semi").select("git_sha", "n")


@query("o30_commit_by_ref", "SELECT git_sha, n, subject FROM {commits} WHERE starts_with(git_sha, 'ab1')")
def commit_by_ref(t: Tables) -> DataFrame:
    return commits.by_ref(t.commits, "ab1").select("git_sha", "n", "subject")


@query("o62_tag_map", "SELECT git_sha, author AS reviewed_by, 'list ' || CAST(n % 7 AS VARCHAR) || '|maintainer' AS cc, 2 AS n_tags FROM {commits}")
def tag_map(t: Tables) -> DataFrame:
    tags = commits.tag_map(t.commits)
    return tags.select("git_sha", F.element_at(F.col("tags")["Reviewed-by"], 1).alias("reviewed_by"), F.array_join(F.col("tags")["Cc"], "|").alias("cc"), F.size("tags").alias("n_tags"))


@query("o71_reachability", f"WITH RECURSIVE {_up('a', 14990)} SELECT n FROM a")
def reachability(t: Tables) -> DataFrame:
    return commits.ancestors(t.parents, _start(t, 14990)).select(F.col("git_sha").alias("n"))


@query("o71_is_ancestor", f"WITH RECURSIVE {_up('a', 14990)} SELECT EXISTS (SELECT 1 FROM a WHERE n = 117) AS yes, EXISTS (SELECT 1 FROM a WHERE n = 14000) AS no")
def is_ancestor(t: Tables) -> DataFrame:
    reached = commits.ancestors(t.parents, _start(t, 14990))
    return reached.agg(F.coalesce(F.max(F.col("git_sha") == 117), F.lit(False)).alias("yes"), F.coalesce(F.max(F.col("git_sha") == 14000), F.lit(False)).alias("no"))


@query(
    "o72_merge_base",
    f"WITH RECURSIVE {_up('a', 14000)}, {_up('b', 14990)}, m AS (SELECT max(n) AS base FROM a WHERE n IN (SELECT n FROM b)) SELECT base, CASE WHEN base = 14000 THEN 'behind' WHEN base = 14990 THEN 'ahead' ELSE 'diverged' END AS state FROM m WHERE base IS NOT NULL",
)
def merge_base(t: Tables) -> DataFrame:
    generation = t.commits.select(F.col("n").alias("git_sha"), F.col("n").alias("generation"))
    base = commits.merge_base(t.parents, generation, _start(t, 14000), _start(t, 14990))
    return base.select(F.col("git_sha").alias("base"), commits.compare_tips(F.col("git_sha"), F.lit(14000), F.lit(14990)).alias("state"))


@query(
    "o72b_branch_status",
    "SELECT s_name AS branch_name, s_suppkey AS tip_commit, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_suppkey ELSE s_suppkey - 1 END AS indexed_tip, CASE s_suppkey % 3 WHEN 0 THEN 'not_indexed' WHEN 1 THEN 'up_to_date' ELSE 'outdated' END AS status FROM {supplier}",
)
def branch_status(t: Tables) -> DataFrame:
    tips = t.supplier.select(F.col("s_name").alias("branch_name"), F.col("s_suppkey").alias("tip_commit"))
    indexed = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("branch_name"), F.expr("IF(s_suppkey % 3 = 1, s_suppkey, s_suppkey - 1)").alias("tip_commit"))
    return commits.branch_status(tips, indexed)


@query(
    "u14_changed_files",
    """
    WITH b AS (SELECT o.file_path AS old_path, o.git_file_hash AS old_hash, n.file_path AS new_path, n.git_file_hash AS new_hash FROM {old_manifest} o FULL JOIN {manifest} n ON o.file_path = n.file_path),
    gone AS (SELECT old_path, old_hash, row_number() OVER (PARTITION BY old_hash ORDER BY old_path) AS r FROM b WHERE new_path IS NULL),
    come AS (SELECT new_path, new_hash, row_number() OVER (PARTITION BY new_hash ORDER BY new_path) AS r FROM b WHERE old_path IS NULL)
    SELECT 'modified' AS change, old_path, new_path FROM b WHERE old_hash <> new_hash
    UNION ALL SELECT CASE WHEN new_path IS NULL THEN 'deleted' WHEN old_path IS NULL THEN 'added' ELSE 'renamed' END, old_path, new_path FROM gone FULL JOIN come ON old_hash = new_hash AND gone.r = come.r
    """,
)
def changed_files(t: Tables) -> DataFrame:
    return commits.changed_files(t.old_manifest, t.manifest)


def _mails(t: Tables) -> DataFrame:
    return t.mails.withColumn("from", F.col("sender")).withColumn("symbols", F.array(F.concat(F.lit("fn_"), (F.col("conv_id") % 5).cast("string"))))


@query("o31_mail_field", "SELECT message_id FROM {mails} WHERE regexp_matches(body, 'the [a-z]+ing', 'i') AND date_timestamp BETWEEN 1600000000 AND 1600500000")
def mail_field(t: Tables) -> DataFrame:
    return mail.search(_mails(t), 1600000000, 1600500000, body=["the [a-z]+ing"]).select("message_id")


@query("o32_mail_fields", "SELECT message_id FROM {mails} WHERE (regexp_matches(sender, 'USER', 'i') OR regexp_matches(sender, '^sys', 'i')) AND regexp_matches(subject, 'topic 1', 'i') AND conv_id % 5 = 1 AND regexp_matches(recipients, 'list[01]', 'i')")
def mail_fields(t: Tables) -> DataFrame:
    return mail.search(_mails(t), from_=["USER", "^sys"], subject=["topic 1"], symbols=["FN_1"], recipients=["list[01]"]).select("message_id")


_FOLD = "strip_accents(lower(body))"


@query("o33_token_probe", f"SELECT message_id FROM {{mails}} WHERE list_contains(regexp_split_to_array({_FOLD}, '[^0-9a-z]+'), 'the') AND list_contains(regexp_split_to_array({_FOLD}, '[^0-9a-z]+'), 'of')")
def token_probe(t: Tables) -> DataFrame:
    return mail.having_all_tokens(mail.token_index(t.mails, "message_id", "body"), "message_id", ["the", "of"])


@query("o34_dig", "SELECT message_id, date_timestamp FROM {mails} WHERE contains(subject, 'topic 12') ORDER BY date_timestamp DESC, message_id LIMIT 100")
def dig(t: Tables) -> DataFrame:
    return mail.by_subject_of(_mails(t), "topic 12").limit(100).select("message_id", "date_timestamp")


@query("o35_message_id", "SELECT message_id, subject FROM {mails} WHERE message_id = '<5:0@list>'")
def message_id(t: Tables) -> DataFrame:
    return mail.by_message_id(t.mails, "5:0@list").select("message_id", "subject")


@query("o36_mails_of_archive_commit", "SELECT message_id FROM {mails} WHERE sha1(CAST(conv_id AS STRING)) = sha1('7')")
def mails_of_archive_commit(t: Tables) -> DataFrame:
    return t.mails.where(F.sha1(F.col("conv_id").cast("string").cast("binary")) == F.sha1(F.lit("7").cast("binary"))).select("message_id")


@query("o63_sort_by_date", "SELECT message_id, row_number() OVER (ORDER BY date_timestamp DESC, message_id) AS newest_place, row_number() OVER (ORDER BY date_timestamp, message_id) AS oldest_place FROM {mails}")
def sort_by_date(t: Tables) -> DataFrame:
    newest, oldest = (mail.placed_by_date(t.mails, down).select("message_id", F.col("place").alias(name)) for down, name in ((True, "newest_place"), (False, "oldest_place")))
    return newest.join(oldest, "message_id")


_ROOTS = "r(message_id, root) AS (SELECT message_id, message_id FROM {mails} m WHERE in_reply_to IS NULL OR in_reply_to NOT IN (SELECT message_id FROM {mails}) UNION ALL SELECT m.message_id, root FROM r JOIN {mails} m ON m.in_reply_to = r.message_id)"


@query("o73_thread_root", f"WITH RECURSIVE {_ROOTS} SELECT message_id, root FROM r WHERE message_id IN (SELECT message_id FROM {{mails}} WHERE turn >= 3)")
def thread_root(t: Tables) -> DataFrame:
    return mail.thread_root(t.mails, t.mails.where("turn >= 3").select("message_id"))


@query("o73_full_thread", f"WITH RECURSIVE {_ROOTS} SELECT message_id FROM r WHERE root = (SELECT root FROM r WHERE message_id = '<4:1@list>')")
def full_thread(t: Tables) -> DataFrame:
    root = mail.thread_root(t.mails, t.mails.where("message_id = '<4:1@list>'")).select(F.col("root").alias("message_id"))
    return mail.replies(t.mails, root).select("message_id")


@query("o74_replies", "WITH RECURSIVE r(message_id, depth) AS (SELECT message_id, 0 FROM {mails} WHERE turn = 1 UNION SELECT m.message_id, depth + 1 FROM r JOIN {mails} m ON m.in_reply_to = r.message_id) SELECT message_id, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0")
def replies(t: Tables) -> DataFrame:
    return mail.replies(t.mails, t.mails.where("turn = 1"), include_starts=False)


@query(
    "o75_thread_order",
    "WITH RECURSIVE r(message_id, root, path) AS (SELECT message_id, message_id, [lpad(CAST(date_timestamp AS VARCHAR), 12, '0') || ' ' || message_id] FROM {mails} m WHERE in_reply_to IS NULL OR in_reply_to NOT IN (SELECT message_id FROM {mails}) UNION ALL SELECT m.message_id, root, list_append(path, lpad(CAST(date_timestamp AS VARCHAR), 12, '0') || ' ' || m.message_id) FROM r JOIN {mails} m ON m.in_reply_to = r.message_id) SELECT root, row_number() OVER (PARTITION BY root ORDER BY path) AS place, message_id, len(path) - 1 AS depth FROM r",
)
def thread_order(t: Tables) -> DataFrame:
    return mail.thread_order(t.mails)


@query(
    "o75_circular_threads",
    "WITH RECURSIVE r(message_id, root, path) AS (SELECT message_id, message_id, [lpad(CAST(date_timestamp AS VARCHAR), 12, '0') || ' ' || message_id] FROM {looped_mails} m WHERE in_reply_to IS NULL OR in_reply_to NOT IN (SELECT message_id FROM {looped_mails}) OR conv_id % 17 = 5 AND turn = 1 UNION ALL SELECT m.message_id, root, list_append(path, lpad(CAST(date_timestamp AS VARCHAR), 12, '0') || ' ' || m.message_id) FROM r JOIN {looped_mails} m ON m.in_reply_to = r.message_id AND m.message_id <> r.root) SELECT root, row_number() OVER (PARTITION BY root ORDER BY path) AS place, message_id, len(path) - 1 AS depth FROM r",
)
def circular_threads(t: Tables) -> DataFrame:
    return mail.thread_order(t.looped_mails)


@query("o09_new_shards", "SELECT 'l' || CAST(n_regionkey AS VARCHAR) AS list_name, n_nationkey AS shard FROM {nation} n WHERE n_nationkey > coalesce((SELECT max(n_nationkey) FROM {nation} h WHERE h.n_regionkey = n.n_regionkey AND h.n_nationkey < 12 AND h.n_regionkey <> 4), -1)")
def new_shards(t: Tables) -> DataFrame:
    shards = t.nation.select(F.concat(F.lit("l"), F.col("n_regionkey").cast("string")).alias("list_name"), F.col("n_nationkey").alias("shard"))
    return mail.new_shards(shards.where("shard < 12 AND list_name <> 'l4'"), shards)


@query("i03_unindexed_commits", "SELECT n FROM {commits} WHERE n NOT IN (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_linenumber = 3)")
def unindexed_commits(t: Tables) -> DataFrame:
    stored = t.lineitem.where("l_linenumber = 3").select(F.col("l_orderkey").alias("n")).distinct()
    return storage.missing_keys(t.commits.select("n"), stored, ["n"])


@query("s05_mail_timestamp", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - 7200 AS ts, 0 AS broken FROM {orders}")
def mail_timestamp(t: Tables) -> DataFrame:
    date = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    return t.orders.select("o_orderkey", text.mail_timestamp(date).alias("ts"), text.mail_timestamp(F.lit("no date")).cast("int").alias("broken"))


@query("s06_asctime_address", "SELECT o_orderkey, strftime(o_orderdate, '%a %b ') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') || strftime(o_orderdate, ' %H:%M:%S %Y') AS asctime, 'c' || CAST(o_custkey AS VARCHAR) || '@x.org' AS address FROM {orders}")
def asctime_address(t: Tables) -> DataFrame:
    sender = F.concat(F.lit("Some One <c"), F.col("o_custkey").cast("string"), F.lit("@x.org>"))
    return t.orders.select("o_orderkey", text.asctime(F.col("o_orderdate")).alias("asctime"), text.address(sender).alias("address"))


@query("s03_query_tokens", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS tokens FROM {documents}")
def query_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.query_tokens(F.col("text")).alias("tokens"))


@query("s10_hashes", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM {documents}")
def hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("s11_clean_type", "SELECT p_partkey, p_name AS cleaned, list_contains(['SMALL', 'LARGE'], p_type) AS listed FROM {part}")
def clean_type(t: Tables) -> DataFrame:
    dirty = F.concat(F.lit("static const struct "), F.col("p_name"), F.lit(" **&[16] __user"))
    return t.part.select("p_partkey", text.clean_type(dirty).alias("cleaned"), F.col("p_type").isin("SMALL", "LARGE").alias("listed"))


@query("s12_primitive_types", "SELECT id, id % 6 IN (0, 1, 2, 5) AS primitive, id % 6 = 3 AND false AS struct_is FROM {functions}")
def primitive_types(t: Tables) -> DataFrame:
    name = F.expr("CASE id % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'u32' WHEN 2 THEN 'unsigned long' WHEN 3 THEN 'struct int' WHEN 4 THEN name ELSE ' size_t' END")
    return t.functions.select("id", text.is_primitive(name).alias("primitive"), text.is_primitive(F.concat(F.lit("struct "), name)).alias("struct_is"))


@query("s13_type_variants", "SELECT DISTINCT p_name, v AS variant FROM (SELECT p_name, unnest(['struct ' || p_name, p_name, 'union ' || p_name, 'enum ' || p_name]) AS v FROM {part}) x")
def type_variants(t: Tables) -> DataFrame:
    return t.part.select("p_name").distinct().select("p_name", F.explode(text.type_variants(F.concat(F.lit("struct "), "p_name"))).alias("variant"))


@query("s14_identifiers", "SELECT id, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AS name_is, false AS path_is, false AS keyword_is FROM {functions}")
def identifiers(t: Tables) -> DataFrame:
    return t.functions.select("id", text.is_identifier(F.col("name")).alias("name_is"), text.is_identifier(F.col("file_path")).alias("path_is"), text.is_identifier(F.lit("while")).alias("keyword_is"))


@query("s15_called_names", "SELECT id, CASE WHEN body = '' THEN '' ELSE name || repeat('|step', CAST(regexp_matches(body, 'int a') AS INT) * ((strlen(body) - strlen(replace(body, 'step(', ''))) // 5)) END AS names FROM {functions}")
def called_names(t: Tables) -> DataFrame:
    return t.functions.select("id", F.array_join(text.called_names(F.col("body")), "|").alias("names"))


@query("s16_language", "SELECT id, CASE WHEN file_path LIKE '%.rs' THEN 'rs' WHEN file_path LIKE '%.h' THEN 'h' ELSE 'c' END AS extension, CASE WHEN file_path LIKE '%.rs' THEN 'rust' ELSE 'c' END AS language FROM {functions}")
def language(t: Tables) -> DataFrame:
    return t.functions.select("id", text.extension(F.col("file_path")).alias("extension"), text.language(F.col("file_path")).alias("language"))


@query("s17_normal_path", "SELECT id, file_path AS path FROM {functions}")
def normal_path(t: Tables) -> DataFrame:
    messy = F.concat(F.lit("./"), F.replace(F.col("file_path"), F.lit("/"), F.lit("//")))
    return t.functions.select("id", text.normal_path(messy).alias("path"))


@query("s19_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') AS k_text FROM {events}")
def json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.from_json("props", "map<string,string>")["k"].alias("k_text"))


@query("s02_regex_case", "SELECT doc_id, regexp_matches(text, 'THE', 'i') AS insensitive, regexp_matches(text, 'THE') AS sensitive FROM {documents}")
def regex_case(t: Tables) -> DataFrame:
    from ..operators.lookup import matching

    return t.documents.select("doc_id", matching("THE", False, "text").alias("insensitive"), matching("THE", True, "text").alias("sensitive"))
