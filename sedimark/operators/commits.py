"""Commits: filters, tags, ranges and reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _ci(column: Column, pattern: str) -> Column:
    return column.rlike("(?i)" + pattern)


def _some(array: str, pattern: str) -> Column:
    return F.exists(array, lambda s: _ci(s, pattern))


def by_author(patterns: list[str]) -> Column:
    return _any([_ci(F.col("author"), p) for p in patterns])


def by_subject(patterns: list[str]) -> Column:
    return _any([_ci(F.col("subject"), p) for p in patterns])


def by_text(patterns: list[str], separately: bool = False) -> Column:
    """All patterns, in message and diff together or each in one of them."""
    message, diff = F.coalesce("message", F.lit("")), F.coalesce("diff", F.lit(""))
    if separately:
        return _all([_ci(message, p) | _ci(diff, p) for p in patterns])
    return _all([_ci(F.concat(message, F.lit("\n\n"), diff), p) for p in patterns])


def by_symbol(patterns: list[str]) -> Column:
    """All patterns, each for one symbol at least."""
    return _all([_some("symbols", p) for p in patterns])


def by_path(patterns: list[str]) -> Column:
    """Any pattern, for any file."""
    return _any([_some("files", p) for p in patterns])


def filter_commits(commits: DataFrame, author=(), subject=(), text=(), symbol=(), path=(), within: DataFrame | None = None, separately: bool = False) -> DataFrame:
    """All kinds of filters that are given, and reachability (``within``: git_sha)."""
    chosen = [f(list(p)) for f, p in ((by_author, author), (by_subject, subject), (by_symbol, symbol), (by_path, path)) if p]
    if text:
        chosen.append(by_text(list(text), separately))
    out = commits.where(_all(chosen)) if chosen else commits
    return out if within is None else out.join(within.select("git_sha"), "git_sha", "left_semi")


def by_ref(commits: DataFrame, prefix: str) -> DataFrame:
    return commits.where(F.col("git_sha").startswith(prefix))


def tag_map(messages: DataFrame, key: str = "git_sha") -> DataFrame:
    """(key, tags): lines ``Name: value`` of a message as name -> values in order, built within the row.

    A name is letters, digits and dashes with an upper-case letter.
    """
    line = r"^([A-Za-z0-9-]*[A-Z][A-Za-z0-9-]*):[ \t]*(\S.*?)[ \t]*$"
    pairs = F.expr(rf"transform(filter(split(message, '\n'), l -> l RLIKE r'{line}'), l -> named_struct('k', regexp_extract(l, r'{line}', 1), 'v', regexp_extract(l, r'{line}', 2)))")
    tags = F.expr("map_from_entries(transform(array_sort(array_distinct(transform(p, x -> x.k))), k -> named_struct('key', k, 'value', transform(filter(p, x -> x.k = k), x -> x.v))))")
    return messages.select(key, pairs.alias("p")).select(key, tags.alias("tags"))


def chains(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parent edges (child, parent; acyclic) as chains and the edges between them.

    Of a commit's parents one, and of a parent's children one, go on in the same chain.  First: (git_sha, chain, height),
    a chain named after its oldest commit, height counted from there.  Second: (chain, height, to_chain, to_height) of
    all edges that leave a chain.  Heights come by doubling, so a chain a million commits long takes some twenty rounds;
    every round holds one row a commit.
    """
    edges = cut(parents.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    onward = edges.groupBy("child").agg(F.min("parent").alias("parent")).groupBy("parent").agg(F.min("child").alias("child"))
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    at = cut(nodes.join(onward, F.col("node") == F.col("child"), "left").select("node", F.coalesce("parent", "node").alias("end"), F.col("parent").isNotNull().cast("long").alias("height")))
    before = None
    while True:
        total, highest, many = at.agg(F.sum("height"), F.max("height"), F.count(F.lit(1))).head()
        if total == before or not many:
            break
        if highest >= many:
            raise ValueError("the parent edges have a cycle")
        before = total
        far = at.select(F.col("node").alias("middle"), F.col("end").alias("far"), F.col("height").alias("more"))
        at = cut(at.join(far, F.col("end") == F.col("middle")).select("node", F.col("far").alias("end"), (F.col("height") + F.col("more")).alias("height")))
    at = at.select(F.col("node").alias("git_sha"), F.col("end").alias("chain"), "height")
    child, parent = at.toDF("child", "chain", "height"), at.toDF("parent", "to_chain", "to_height")
    crossing = edges.join(child, "child").join(parent, "parent").where("chain <> to_chain").groupBy("chain", "height", "to_chain").agg(F.max("to_height").alias("to_height"))
    return at, cut(crossing)


def ancestors(parents: DataFrame, starts: DataFrame, built: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(git_sha): the starts and whatever their parent edges lead to.

    The walk goes over ``chains``: whoever reaches a commit reaches all below it in its chain, so what is kept is the
    highest commit reached of each chain.  A round follows the edges out of what was newly reached, once each; the rounds
    are as many as changes of chain on the way, not as the history is deep.
    """
    at, crossing = built or chains(parents)
    starts = starts.select("git_sha").distinct()
    reached = cut(at.join(starts, "git_sha", "left_semi").groupBy("chain").agg(F.max("height").alias("top")).withColumn("done", F.lit(-1).cast("long")))
    while True:
        # done: up to where the edges out of the chain have been followed before.
        new = reached.where("top > done").select("chain", "top", "done")
        found = crossing.join(new, "chain").where("height <= top AND height > done").select(F.col("to_chain").alias("chain"), F.col("to_height").alias("top"))
        state = reached.select("chain", "top", F.col("top").alias("done")).unionByName(found.withColumn("done", F.lit(-1).cast("long")))
        reached = cut(state.groupBy("chain").agg(F.max("top").alias("top"), F.max("done").alias("done")))
        if reached.where("top > done").isEmpty():
            break
    return at.join(reached, "chain").where("height <= top").select("git_sha").union(starts).distinct()


def commit_range(parents: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Reachable from ``new`` and not from ``old``."""
    built = chains(parents)
    return ancestors(parents, new, built).join(ancestors(parents, old, built), "git_sha", "left_anti")


def merge_base(parents: DataFrame, generation: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(git_sha, generation): of the common ancestors the one that is latest by ``generation`` (git_sha, generation)."""
    built = chains(parents)
    common = ancestors(parents, a, built).join(ancestors(parents, b, built), "git_sha", "left_semi")
    return common.join(generation, "git_sha").orderBy(F.desc("generation"), "git_sha").limit(1)


def compare_tips(base: Column, a: Column, b: Column) -> Column:
    return F.when(a == b, "identical").when(base == a, "behind").when(base == b, "ahead").otherwise("diverged")


def branch_status(tips: DataFrame, indexed: DataFrame) -> DataFrame:
    """Branches by name with what is indexed of them: up_to_date, outdated or not_indexed."""
    known = indexed.select("branch_name", F.col("tip_commit").alias("indexed_tip"))
    status = F.when(F.col("indexed_tip").isNull(), "not_indexed").when(F.col("indexed_tip") == F.col("tip_commit"), "up_to_date").otherwise("outdated")
    return tips.join(known, "branch_name", "left").withColumn("status", status)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, old_path, new_path): added, modified, deleted, and renamed where a hash left one path for another."""
    o = old.select(F.col("file_path").alias("old_path"), F.col("git_file_hash").alias("old_hash"))
    n = new.select(F.col("file_path").alias("new_path"), F.col("git_file_hash").alias("new_hash"))
    both = o.join(n, F.col("old_path") == F.col("new_path"), "full").where("NOT (old_hash <=> new_hash)")
    modified = both.where("old_path IS NOT NULL AND new_path IS NOT NULL").select(F.lit("modified").alias("change"), "old_path", "new_path")
    order = lambda k, p: Window.partitionBy(k).orderBy(p)
    gone = both.where("new_path IS NULL").withColumn("r", F.row_number().over(order("old_hash", "old_path"))).select("old_path", "old_hash", "r")
    come = both.where("old_path IS NULL").withColumn("r", F.row_number().over(order("new_hash", "new_path"))).select("new_path", "new_hash", F.col("r").alias("s"))
    paired = gone.join(come, (F.col("old_hash") == F.col("new_hash")) & (F.col("r") == F.col("s")), "full")
    change = F.when(F.col("new_path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    return modified.unionByName(paired.select(change.alias("change"), "old_path", "new_path"))
