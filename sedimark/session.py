"""The store as seen at a commit, a branch or the working directory: one view, the verbs as methods."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .checkpoints import cut
from .functions.embedding import embed
from .functions.text import tokens
from .operators import commits, graph, grep, lookup, mail, ranking, storage, vectors
from .sources.git import GitSource, resolve
from .streaming.ingest import ingest_sources, rows_of


def store_path(given: str | None = None, source: str | None = None) -> str:
    """Where the store is: as told, by SEDIMARK_STORE, in the source folder, in the current one."""
    if given:
        return given
    if found := os.environ.get("SEDIMARK_STORE"):
        return found
    return os.path.join(source or os.getcwd(), ".sedimark")


@dataclass(frozen=True)
class View:
    """Tables restricted to a manifest (all versions where it is None), with a working directory's rows over them."""

    catalog: Catalog
    manifest: DataFrame | None = None
    overlay: DataFrame | None = None
    touched: DataFrame | None = None
    overlay_types: DataFrame | None = None
    overlay_content: DataFrame | None = None

    def _at(self, rows: DataFrame) -> DataFrame:
        return rows if self.manifest is None else lookup.at_commit(rows, self.manifest)

    @property
    def content(self) -> DataFrame:
        stored = self.catalog.load("content").select("hash", "content")
        return stored if self.overlay_content is None else self.overlay_content.unionByName(storage.missing_keys(stored, self.overlay_content, ["hash"]))

    @property
    def functions(self) -> DataFrame:
        rows = self._at(self.catalog.load("functions"))
        return rows if self.overlay is None else lookup.with_overlay(rows, self.overlay, self.touched)

    @property
    def types(self) -> DataFrame:
        rows = self._at(self.catalog.load("types"))
        return rows if self.overlay_types is None else lookup.with_overlay(rows, self.overlay_types, self.touched)

    def with_bodies(self, rows: DataFrame) -> DataFrame:
        return storage.resolve_content(rows, self.content, "body_hash").withColumn("n_params", F.coalesce(F.size("parameters"), F.lit(0)))

    def find_function(self, name: str) -> DataFrame:
        """The best definition of exactly that name, else rows it matches as an expression."""
        found = lookup._tiers(self.functions, [F.col("name") == name, lookup.matching(name, False)])
        return ranking.best_definition(self.with_bodies(found))

    def find_type(self, name: str) -> DataFrame:
        plain = name
        for keyword in ("struct ", "union ", "enum "):
            plain = plain.removeprefix(keyword)
        return lookup._tiers(self.types, [F.col("name") == plain, lookup.matching(plain, False)])

    def callers(self, name: str) -> DataFrame:
        return graph.callers(self.functions, name)

    def callees(self, name: str) -> DataFrame:
        return graph.callees(ranking.best_by_extent(self.functions), name)

    def edges(self) -> DataFrame:
        return graph.call_edges(self.functions).distinct()

    def callchain(self, name: str, depth: int = 3, direction: str = "forward") -> DataFrame:
        return graph.tree(self.edges(), self._names(name), depth, direction)

    def paths(self, target: str, depth: int = 10) -> DataFrame:
        edges = self.edges()
        return graph.paths_to(edges, graph.entry_points(edges), target, depth)

    def grep(self, pattern: str, path: str | None = None, limit: int = 100) -> DataFrame:
        """Bodies that match; limit 0 is none."""
        found = grep.grep_bodies(self.functions, self.content, pattern, path).orderBy("file_path", "line_start", "name")
        return found if not limit else found.limit(limit)

    def vgrep(self, text: str, limit: int = 10, path: str | None = None) -> DataFrame:
        """Functions nearest to a text, the view and the path applied before the cut."""
        rows = self.functions if path is None else self.functions.where(F.col("file_path").rlike(path))
        store = vectors.by_keys(self.catalog.load("vectors"), rows.select(F.col("body_hash").alias("content_hash")), "content_hash")
        scores = vectors.top_k(store, "content_hash", "vector", self._embed(text), limit)
        return vectors.hits(scores.withColumnRenamed("content_hash", "body_hash"), rows, "body_hash").orderBy(F.desc("score"), "name").limit(limit)

    def find_commits(self, within: DataFrame | None = None, limit: int = 50, **filters) -> DataFrame:
        found = commits.filter_commits(self.catalog.load("git_commits"), within=within, **filters).orderBy("git_sha")
        return found if not limit else found.limit(limit)

    def commit_range(self, old: str, new: str) -> DataFrame:
        spark = self.catalog.spark
        parents = self.catalog.load("git_commits").select(F.col("git_sha").alias("child"), F.explode("parent_sha").alias("parent"))
        start = lambda sha: spark.createDataFrame([(sha,)], "git_sha string")
        return commits.commit_range(parents, start(old), start(new))

    def vcommits(self, text: str, limit: int = 10, **filters) -> DataFrame:
        """Commits nearest to a text, the filters applied before the cut."""
        rows = commits.filter_commits(self.catalog.load("git_commits"), **filters)
        return self._nearest("commit_vectors", "git_commit_sha", rows.withColumn("git_commit_sha", F.col("git_sha")), text, limit)

    def vmails(self, text: str, limit: int = 10, since: int | None = None, until: int | None = None, **patterns) -> DataFrame:
        """Mails nearest to a text, the filters applied before the cut."""
        return self._nearest("lore_vectors", "message_id", mail.search(self.catalog.load("lore"), since, until, **patterns), text, limit)

    def _nearest(self, table: str, key: str, rows: DataFrame, text: str, limit: int) -> DataFrame:
        store = vectors.by_keys(self.catalog.load(table), rows.select(key), key)
        scores = vectors.top_k(store, key, "vector", self._embed(text), limit)
        return vectors.hits(scores, rows, key).orderBy(F.desc("score"), key)

    def search_mail(self, since: int | None = None, until: int | None = None, limit: int = 100, **patterns) -> DataFrame:
        return mail.by_date(mail.search(self.catalog.load("lore"), since, until, **patterns), True).limit(limit)

    def mails_with_words(self, words: str) -> DataFrame:
        """Mails that have all words, by the stored index: only the buckets of those words are read."""
        wanted = [w for w in self.catalog.spark.createDataFrame([(words,)], "t string").select(F.array_distinct(tokens(F.col("t")))).first()[0]]
        found = mail.having_all_tokens(self.catalog.load("lore_tokens", token=wanted), "message_id", wanted)
        return self.catalog.load("lore").join(found, "message_id", "left_semi")

    def thread(self, message_id: str) -> DataFrame:
        mails = self.catalog.load("lore")
        root = mail.thread_root(mails, mail.by_message_id(mails, message_id).select("message_id"))
        members = mail.replies(mails, root.select(F.col("root").alias("message_id")))
        return mail.thread_order(mails.join(members.select("message_id"), "message_id", "left_semi"))

    def dig(self, subject: str) -> DataFrame:
        return mail.by_subject_of(self.catalog.load("lore"), subject)

    def tables(self) -> DataFrame:
        names = ("functions", "types", "content", "symbol_filename", "processed_files", "git_commits", "lore", "vectors")
        return storage.table_statistics({n: self.catalog.load(n) for n in names})

    def definition(self, word: str) -> DataFrame:
        """Where a word is defined: function before macro before type before typedef."""
        place = lambda df, rank: df.where(F.col("name") == word).select(rank.alias("rank"), "file_path", F.col(df.columns[3]).alias("line"))
        found = place(self.functions, F.when(F.col("return_type") == "", 1).otherwise(0)).unionByName(place(self.types, F.when(F.col("kind") == "typedef", 3).otherwise(2)))
        return found.orderBy("rank", "file_path", "line").limit(1)

    def references(self, word: str) -> DataFrame:
        """Where a function's callers are defined."""
        return self.functions.join(self.callers(word), "name", "left_semi").select("name", "file_path", "line_start")

    def embed_content(self) -> None:
        """Vectors of bodies that have none yet."""
        due = storage.missing_keys(self.content.select(F.col("hash").alias("content_hash"), "content"), self.catalog.load("vectors"), ["content_hash"])
        self.catalog.merge("vectors", embed(due, "content_hash", F.col("content")))

    def embed_commits(self) -> None:
        """Vectors of commit messages that have none yet."""
        rows = self.catalog.load("git_commits").select(F.col("git_sha").alias("git_commit_sha"), F.concat_ws("\n", "subject", "message").alias("content"))
        self.catalog.merge("commit_vectors", embed(storage.missing_keys(rows, self.catalog.load("commit_vectors"), ["git_commit_sha"]), "git_commit_sha", F.col("content")))

    def embed_mails(self) -> None:
        """Vectors of mails that have none yet."""
        rows = self.catalog.load("lore").select("message_id", F.concat_ws("\n", "subject", "body").alias("content"))
        self.catalog.merge("lore_vectors", embed(storage.missing_keys(rows, self.catalog.load("lore_vectors"), ["message_id"]), "message_id", F.col("content")))

    def index_vectors(self) -> None:
        """The stored index of all content vectors, made anew; none where there are too few of them."""
        store = self.catalog.load("vectors")
        clusters = vectors.cluster_count(store.count())
        if clusters:
            model = vectors.fit_index(store, "vector", clusters)
            self.catalog.save("vector_index", vectors.assign(store, "content_hash", "vector", model))
            self.catalog.save("vector_model", self.catalog.spark.createDataFrame(model.rows(), "name string, dimension int, part int, data binary"))

    def vprobe(self, text: str, limit: int = 10, probes: int = 10) -> DataFrame:
        """(content_hash, score) of the content nearest to a text by the stored index."""
        model = vectors.IndexModel.of(self.catalog.load("vector_model").collect())
        return vectors.probe(self.catalog.load("vector_index"), self.catalog.load("vectors"), "content_hash", "vector", model, self._embed(text), limit, probes)

    def _names(self, *names: str) -> DataFrame:
        return self.catalog.spark.createDataFrame([(n,) for n in names], "name string")

    def _embed(self, text: str) -> list[float]:
        one = self.catalog.spark.createDataFrame([(0, text)], "k int, text string")
        return embed(one, "k", F.col("text")).first()["vector"]


class Engine:
    """A store and, where there is one, the repository it was made from."""

    def __init__(self, spark: SparkSession, root: str, repo: str | None = None):
        self.spark, self.catalog, self.repo = spark, Catalog(spark, root), repo
        spark.dataSource.register(GitSource)

    def everything(self) -> View:
        return View(self.catalog)

    def at(self, branch: str | None = None, sha: str | None = None) -> View:
        """The view at a branch, else a commit, else HEAD."""
        rev = resolve(self.repo, branch, sha)
        return View(self.catalog, self.git("tree", rev).select("file_path", "git_file_hash"))

    def with_overlay(self, view: View, rows: DataFrame, touched: DataFrame) -> View:
        """A snapshot of the working directory over a view: its rows, and the paths changed or deleted."""
        return replace(view, overlay=rows, touched=touched)

    def workdir(self, view: View) -> View:
        """A snapshot of the working directory over a view: modified and staged files are read anew, deleted ones are gone.

        The snapshot is materialised, so that all verbs of the view see the same files.
        """
        changed = cut(self.git("workdir"))
        functions, types, content = rows_of(changed.where("NOT deleted").select("file_path", "git_file_hash", "content"))
        return replace(view, overlay=functions, touched=changed.select("file_path"), overlay_types=types, overlay_content=content.select("hash", "content"))

    def ingest_branch(self, name: str) -> int:
        """Files of a branch that aren't stored yet; the whole tree where the branch is new, what changed since its tip else.  Marks the tip last."""
        tip = resolve(self.repo, branch=name)
        if not tip.strip("0"):
            raise ValueError(f"no branch {name}")
        with self.catalog.task(f"branch-{name.replace('/', '_')}"):
            known = {r["branch_name"]: r["tip_commit"] for r in self.branches().where(F.col("branch_name") == name).collect()}
            n = 0
            if known.get(name) != tip:
                blobs = self.git("blobs", tip)
                if name in known:
                    before = self.git("tree", known[name]).select("file_path", "git_file_hash")
                    blobs = storage.missing_keys(blobs, before, ["file_path", "git_file_hash"])
                n = ingest_sources(self.catalog, blobs, tip)
                remote = name.split("/")[0] if "/" in name and self.git("refs").where((F.col("branch_name") == name) & F.col("remote").isNotNull()).count() else None
                row = self.spark.createDataFrame([(name, tip, int(time.time()), remote)], "branch_name string, tip_commit string, indexed_at bigint, remote string")
                self.catalog.merge("indexed_branches", row)
        return n

    def branches(self, remote: str | None = None, commit: str | None = None) -> DataFrame:
        """Branches that are indexed, of a remote, at a commit."""
        found = self.catalog.load("indexed_branches")
        found = found if remote is None else found.where(F.col("remote") == remote)
        return found if commit is None else found.where(F.col("tip_commit") == commit)

    def forget_branch(self, name: str) -> None:
        self.catalog.delete("indexed_branches", F.col("branch_name") == name)

    def status(self) -> DataFrame:
        """(branch_name, tip_commit, indexed_tip, status) of every branch of the repository."""
        return commits.branch_status(self.git("refs").select("branch_name", "tip_commit"), self.branches())

    def git(self, scan: str, rev: str = "HEAD") -> DataFrame:
        return self.spark.read.format("git").option("repo", self.repo).option("scan", scan).option("rev", rev).load()
