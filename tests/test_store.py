"""The store, the git source, ingest and the view over them."""

import json
import subprocess
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sedimark.catalog import Catalog
from sedimark.functions import dates, text
from sedimark.operators import commits
from sedimark.session import Engine, View, store_path
from sedimark.sources.git import GitSource, normal_rev, resolve
from sedimark.sources.mail import parse_headers, parse_mails, write_json, write_mbox
from sedimark.streaming.ingest import ingest_commits, ingest_mails, ingest_sources, stream_mails

ONE = "int helper(int a)\n{\n\treturn a + 1;\n}\n\nint top(void)\n{\n\treturn helper(1);\n}\n"
TWO = ONE.replace("helper(1)", "other(helper(2))")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("git")
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=A", "-c", "user.email=a@x.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q", "-b", "main")
    (path / "a.c").write_text(ONE)
    (path / "b.py").write_text("def f():\n    return 1\n")
    run("add", "."), run("commit", "-qm", "first\n\nReviewed-by: B <b@x.org>")
    (path / "a.c").write_text(TWO)
    run("commit", "-qam", "second")
    run("checkout", "-qb", "side", "HEAD~1")
    (path / "c.h").write_text("struct s { int x; };\n")
    run("add", "."), run("commit", "-qm", "third")
    run("checkout", "-q", "main"), run("merge", "-q", "--no-edit", "side")
    return str(path)


def test_git_source(spark, repo):
    spark.dataSource.register(GitSource)
    read = lambda scan, rev="HEAD": spark.read.format("git").option("repo", repo).option("scan", scan).option("rev", rev).load()
    assert sorted(r["file_path"] for r in read("tree").collect()) == ["a.c", "b.py", "c.h"]
    assert sorted(r["file_path"] for r in read("tree", "HEAD~1").collect()) == ["a.c", "b.py"]
    assert {r["file_path"]: r["content"] for r in read("blobs").collect()}["a.c"] == TWO
    history = {r["subject"]: r for r in read("commits").collect()}
    assert history["second"]["files"] == ["a.c"] and "+\treturn other(helper(2));" in history["second"]["diff"]
    assert history["first"]["files"] == [] and len(history) == 4
    assert {r["subject"] for r in read("commits", "HEAD~1..side").collect()} == {"third"}
    assert {r["branch_name"] for r in read("refs").collect()} == {"main", "side"}
    assert normal_rev("v1~2") == "v1^{commit}~2" and normal_rev("main") == "main"
    assert resolve(repo, branch="nowhere") == "0" * 40 and resolve(repo) == resolve(repo, branch="main")


def test_ingest_and_view(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), repo)
    blobs = engine.git("blobs", "HEAD~1")
    assert ingest_sources(engine.catalog, blobs) == 2
    assert ingest_sources(engine.catalog, engine.git("blobs", "HEAD")) == 1
    assert ingest_sources(engine.catalog, engine.git("blobs", "HEAD")) == 0
    assert ingest_sources(engine.catalog, engine.git("blobs", "HEAD~1^")) == 1
    view, old = engine.at(), engine.at(sha="HEAD~1^")
    assert [r["callee"] for r in view.callees("top").orderBy("callee").collect()] == ["helper", "other"]
    assert [r["callee"] for r in old.callees("top").collect()] == ["helper"]
    assert [r["name"] for r in view.callers("other").collect()] == ["top"] and old.callers("other").count() == 0
    assert view.grep("return a \\+ 1").select("name").first()[0] == "helper"
    assert view.find_type("struct s").first()["file_path"] == "c.h" and view.find_function("hel.*").first()["name"] == "helper"
    assert view.definition("helper").first()["line"] == 1 and view.references("helper").first()["name"] == "top"
    view.embed_content()
    assert view.vgrep("return a + 1 helper", 1).first()["name"] == "helper"
    view.index_vectors()  # too few for an index
    assert engine.catalog.load("vector_index").count() == 0
    edited = view.functions.where("name = 'top'").withColumn("calls", F.array(F.lit("edited")))
    over = engine.with_overlay(view, edited, spark.createDataFrame([("a.c",)], "file_path string"))
    assert [r["name"] for r in over.callers("edited").collect()] == ["top"] and over.callers("helper").count() == 0
    assert ingest_commits(engine.catalog, engine.git("commits")) == 4 and ingest_commits(engine.catalog, engine.git("commits")) == 0
    first = engine.catalog.load("git_commits").where("subject = 'first'").first()
    assert first["tags"] == {"Reviewed-by": ["B <b@x.org>"]}
    view.embed_commits()
    assert view.vcommits("first", 1).first()["subject"] == "first"
    second = engine.catalog.load("git_commits").where("subject = 'second'").first()
    assert second["symbols"] == ["top()"]
    assert view.commit_range(resolve(repo, sha="HEAD~1"), resolve(repo, branch="side")).count() == 1
    assert {r["table_name"]: r["n"] for r in view.tables().collect()}["git_commits"] == 4


def test_branches_and_status(spark, repo, tmp_path):
    """Indexed branches: all of a tree first, what changed afterwards; up to date, outdated and unknown ones."""
    engine = Engine(spark, str(tmp_path / "store"), repo)
    assert engine.ingest_branch("side") == 3 and engine.ingest_branch("side") == 0
    assert {r["branch_name"]: r["status"] for r in engine.status().collect()} == {"main": "not_indexed", "side": "up_to_date"}
    assert engine.ingest_branch("main") == 1
    assert engine.branches(commit=resolve(repo, branch="side")).first()["branch_name"] == "side" and engine.branches(remote="origin").count() == 0
    old = engine.branches().where("branch_name = 'main'").withColumn("tip_commit", F.lit(resolve(repo, sha="main~1")))
    engine.catalog.merge("indexed_branches", old)
    assert {r["branch_name"]: r["status"] for r in engine.status().collect()}["main"] == "outdated"
    assert engine.ingest_branch("main") == 0 and engine.branches().where("branch_name = 'main'").first()["tip_commit"] == resolve(repo, branch="main")
    engine.forget_branch("side")
    assert [r["branch_name"] for r in engine.branches().collect()] == ["main"]
    with pytest.raises(ValueError):
        engine.ingest_branch("it's none")
    states = {r["task"]: r["state"] for r in engine.catalog.task_states("branch-main", "never").collect()}
    assert states == {"branch-main": "Completed", "never": "NotStarted"}
    with pytest.raises(KeyError), engine.catalog.task("broken"):
        raise KeyError("x")
    assert engine.catalog.task_states("broken").first()["state"] == "Failed"


def test_working_directory(spark, tmp_path):
    """Clean, modified, staged and deleted files: definitions, types, callers, bodies and lookups see what is there now."""
    path = tmp_path / "git"
    path.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=A", "-c", "user.email=a@x.org", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (path / "a.c").write_text(ONE)
    (path / "gone.c").write_text("int gone(void)\n{\n\treturn helper(2);\n}\n")
    (path / "t.h").write_text("struct kept { int x; };\n")
    run("add", "."), run("commit", "-qm", "first")
    engine = Engine(spark, str(tmp_path / "store"), str(path))
    engine.ingest_branch("main")
    view = engine.at()
    clean = engine.workdir(view)
    assert clean.touched.count() == 0 and {r["name"] for r in clean.callers("helper").collect()} == {"top", "gone"}
    (path / "a.c").write_text(TWO)
    (path / "new.c").write_text("struct fresh { int y; };\nint added(void)\n{\n\treturn other(7);\n}\n")
    run("add", "new.c"), (path / "gone.c").unlink()
    (path / "untracked.c").write_text("int untracked(void)\n{\n\treturn 1;\n}\n")
    over = engine.workdir(view)
    assert {r["file_path"] for r in over.touched.collect()} == {"a.c", "new.c", "gone.c"}
    assert {r["name"] for r in over.callers("other").collect()} == {"top", "added"} and {r["name"] for r in over.callers("helper").collect()} == {"top"}
    assert {r["name"] for r in over.grep("other").collect()} == {"top", "added"} and over.grep("return helper\\(2\\)").count() == 0
    assert over.find_type("struct fresh").first()["file_path"] == "new.c" and over.find_type("kept").count() == 1 and view.find_type("fresh").count() == 0
    assert over.find_function("added").first()["body"].startswith("int added") and over.functions.where("name = 'untracked'").count() == 0


def test_catalog_writes_only_what_it_touches(spark, tmp_path):
    store = Catalog(spark, str(tmp_path), buckets=8)
    rows = spark.range(200).selectExpr("concat('b', id) AS branch_name", "'t' AS tip_commit", "id AS indexed_at", "CAST(NULL AS string) AS remote")
    store.merge("indexed_branches", rows)
    before = store.state("indexed_branches")[1]
    store.merge("indexed_branches", rows.where("branch_name = 'b7'").withColumn("tip_commit", F.lit("new")))
    after = store.state("indexed_branches")[1]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert store.load("indexed_branches", branch_name=["b7", "b8"]).orderBy("branch_name").select("tip_commit").collect() == [("new",), ("t",)]
    one = lambda tip, n: ("same", tip, n, None)
    twice = spark.createDataFrame([one("x", 1), one("z", 2), one("y", 3)], rows.schema)
    store.merge("indexed_branches", twice)
    assert store.load("indexed_branches").where("branch_name = 'same'").count() == 1
    # Another writer takes the number first: the work is done again on its state, and nothing is lost.
    taken, create = [], store._create

    def late(file, text):
        if not taken and "/states/" in file:
            taken.append(file)
            Catalog(spark, str(tmp_path), buckets=8).merge("indexed_branches", spark.createDataFrame([("other", "o", 1, None)], rows.schema))
        return create(file, text)

    store._create = late
    store.merge("indexed_branches", spark.createDataFrame([("mine", "m", 1, None)], rows.schema))
    assert {r[0] for r in store.load("indexed_branches").where("branch_name IN ('other', 'mine')").select("branch_name").collect()} == {"other", "mine"}
    store._create = create
    for i in range(3):
        store.append("processed_files", spark.createDataFrame([(f"f{i}", None, "s")], "file string, git_sha string, git_file_sha string"))
    assert store.load("processed_files").count() == 3 and store.due("processed_files") and "processed_files" in store.maintain()
    assert store.load("processed_files").count() == 3 and store.fragments("processed_files")[0] == 1 and not store.due("processed_files")


def test_catalog(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    row = lambda b, t: (b, t, 1, None)
    ddl = "branch_name string, tip_commit string, indexed_at bigint, remote string"
    store.merge("indexed_branches", spark.createDataFrame([row("main", "a"), row("it's", "b")], ddl))
    store.merge("indexed_branches", spark.createDataFrame([row("main", "c")], ddl))
    assert {r["branch_name"]: r["tip_commit"] for r in store.load("indexed_branches").collect()} == {"main": "c", "it's": "b"}
    store.delete("indexed_branches", F.col("branch_name") == "it's")
    assert store.load("indexed_branches").count() == 1 and store.load("lore").count() == 0
    store.compact("indexed_branches")
    assert store.load("indexed_branches").count() == 1
    store.drop("indexed_branches")
    assert store.load("indexed_branches").count() == 0
    assert store_path("x") == "x" and store_path(None, "/src") == "/src/.sedimark"


RAW = "From: A <a@x.org>\nSubject: one\n two\nMessage-ID: <{}@x>\nDate: Mon, 6 Jan 2020 10:00:00 +0000\nTo: l@x.org\n{}\nbody\n"


def test_mail(spark, tmp_path):
    assert parse_headers("A: b\n c\nA: d\n\nx")[0] == {"a": "b c"}
    raw = spark.createDataFrame([("c1", RAW.format(1, "")), ("c2", RAW.format(2, "In-Reply-To: <1@x>\n")), ("c3", "no headers")], "git_commit_sha string, raw string")
    store = Catalog(spark, str(tmp_path / "s"))
    assert ingest_mails(store, raw) == 2 and ingest_mails(store, raw) == 0
    mails = store.load("lore")
    assert mails.where("message_id = '<1@x>'").first()["subject"] == "one two"
    write_mbox(parse_mails(raw), str(tmp_path / "mbox"))
    assert "From a@x.org Mon Jan  6 10:00:00 2020" in "".join(r[0] + "\n" for r in spark.read.text(str(tmp_path / "mbox")).collect())
    write_json(mails, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"git_commit_sha": "c9", "raw": RAW.format(9, "")}))
    view = View(store)
    assert view.mails_with_words("ONE two").count() == 2 and view.mails_with_words("one nowhere").count() == 0
    view.embed_mails()
    assert view.vmails("one two body", 1, subject=["one"]).first()["score"] > 0.9
    stream_mails(spark, store, str(folder), str(tmp_path / "offsets")).start().awaitTermination()
    assert store.load("lore").count() == 3


def test_dates():
    now = datetime(2024, 3, 31, 12, tzinfo=timezone.utc)
    assert dates.parse_date("yesterday", now).day == 30 and dates.parse_date("7 days ago", now).day == 24
    assert dates.parse_date("1 month ago", now).day == 29 and dates.parse_date("2024-11-13").month == 11
    for wrong in ("garbage", "", "7 days"):
        with pytest.raises(ValueError):
            dates.parse_date(wrong)
    assert dates.rfc2822(dates.parse_date("2024-11-13")).startswith("Wed, 13 Nov 2024")


def test_text(spark):
    df = spark.createDataFrame([("é" * 5000 + " tail",)], "t string")
    cut = df.select(text.code_for_embedding(F.col("t"))).first()[0]
    assert cut == "é" * 4096
    wide = spark.createDataFrame([("a" * 8190 + "😀b",)], "t string").select(text.code_for_embedding(F.col("t"))).first()[0]
    assert wide == "a" * 8190
    assert df.select(text.fold(F.lit("Éàü"))).first()[0] == "eau"


def test_vector_index(spark, tmp_path):
    """Product codes and clusters, stored and read again: recall against the exact search, originals' scores."""
    import numpy as np

    from sedimark.functions.embedding import embed
    from sedimark.operators import vectors

    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 30)) + 2 * rng.standard_normal((20, 30))[rng.integers(0, 20, 3000)]
    df = spark.createDataFrame([(f"h{i}", v.tolist()) for i, v in enumerate(x)], "content_hash string, vector array<double>")
    store = Catalog(spark, str(tmp_path))
    store.merge("vectors", df)
    view = View(store)
    view.index_vectors()
    model, again = vectors.fit_index(store.load("vectors"), "vector", 256), vectors.IndexModel.of(store.load("vector_model").collect())
    assert again.parts.shape == (8, 256, 4) and again.centres.shape == (256, 30) and np.allclose(model.centres, again.centres)
    hits = 0
    for q in range(0, 3000, 300):
        near = vectors.probe(store.load("vector_index"), store.load("vectors"), "content_hash", "vector", again, x[q].tolist(), 10, probes=32)
        found, exact = ({r["content_hash"]: r["score"] for r in df.collect()} for df in (near, vectors.top_k(store.load("vectors"), "content_hash", "vector", x[q].tolist(), 10)))
        hits += len(found.keys() & exact.keys())
        assert all(abs(found[h] - exact[h]) < 1e-9 for h in found.keys() & exact.keys())
    assert hits >= 90
    own = {r["k"]: r["vector"] for r in embed(spark.createDataFrame([(1, "to be or not to be"), (2, ""), (3, None)], "k int, t string"), "k", F.col("t")).collect()}
    assert abs(sum(v * v for v in own[1]) - 1) < 1e-6 and not any(own[2]) and not any(own[3]) and len(own[1]) == 256


def test_pages_far_away(spark):
    from sedimark.operators import storage

    df = spark.range(50_000).selectExpr("id", "id * 7 % 50000 AS k").repartition(5)
    far, near = storage.page(df, [F.col("k")], 400, 100), storage.page(df, [F.col("k")], 3, 100)
    assert [r["k"] for r in far.orderBy("k").collect()] == list(range(39_900, 40_000)) and [r["k"] for r in near.collect()] == list(range(200, 300))
    assert [r["id"] for r in storage.page_after(df, "id", 41, 3).collect()] == [42, 43, 44]


def test_bodies_are_cut_in_bytes(spark):
    from sedimark.operators import storage

    df = spark.createDataFrame([("é" * 10,), ("é" * 10 + "x",), ("short",)], "t string")
    assert {r["content"] for r in storage.content_store(df, "t", 13).collect()} == {"é" * 6, "short"}
    assert storage.content_store(df, "t", None).count() == 3


def brute_ancestors(edges, starts):
    up, seen, todo = {}, set(starts), list(starts)
    for c, p in edges:
        up.setdefault(c, []).append(p)
    while todo:
        for p in up.get(todo.pop(), []):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def test_history_with_merges(spark):
    """A third of the commits are merges; every reachability by a plain walk, in rounds of few rows."""
    import random

    rng = random.Random(9)
    edges = {(i, i - 1) for i in range(1, 3000)} | {(i, rng.randrange(max(0, i - 40), i)) for i in range(1, 3000) if rng.random() < 0.3}
    edges -= {(i, i - 1) for i in range(1, 3000) if rng.random() < 0.05 and sum(c == i for c, _ in [(i, 0)]) and (i, i - 1) in edges and any((i, p) in edges for p in range(max(0, i - 40), i - 1))}
    parents = spark.createDataFrame(sorted(edges), "child long, parent long")
    start = lambda *n: spark.createDataFrame([(i,) for i in n], "git_sha long")
    at, crossing = commits.chains(parents)
    assert at.count() == len({n for e in edges for n in e}) and crossing.count() <= len(edges)
    for starts in ([2999], [1500, 40], [77_777]):
        assert {r["git_sha"] for r in commits.ancestors(parents, start(*starts), (at, crossing)).collect()} == brute_ancestors(edges, starts)
    found = {r["git_sha"] for r in commits.commit_range(parents, start(1200), start(1800)).collect()}
    assert found == brute_ancestors(edges, [1800]) - brute_ancestors(edges, [1200])
    with pytest.raises(ValueError):
        commits.chains(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long"))


def test_circular_replies(spark):
    """No mail of a circle, or below one, is lost; the earliest of the circle is the root."""
    from sedimark.operators import mail

    rows = [("x", "y", 30), ("y", "x", 20), ("z", "y", 40), ("w", "z", 50), ("self", "self", 5), ("a", None, 1), ("b", "a", 2), ("c", "missing", 3), ("p", "q", 9), ("q", "r", 8), ("r", "p", 7), ("u", "p", 6)]
    mails = spark.createDataFrame(rows, "message_id string, in_reply_to string, date_timestamp long")
    found = {r["message_id"]: (r["root"], r["place"], r["depth"]) for r in mail.thread_order(mails).collect()}
    assert found == {"y": ("y", 1, 0), "x": ("y", 2, 1), "z": ("y", 3, 1), "w": ("y", 4, 2), "self": ("self", 1, 0), "a": ("a", 1, 0), "b": ("a", 2, 1), "c": ("c", 1, 0), "r": ("r", 1, 0), "q": ("r", 2, 1), "p": ("r", 3, 2), "u": ("r", 4, 3)}


def test_deep_history(spark):
    parents = spark.range(1, 1500).selectExpr("id AS child", "id - 1 AS parent")
    assert commits.ancestors(parents, spark.createDataFrame([(1400,)], "git_sha bigint")).count() == 1401
