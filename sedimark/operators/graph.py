"""Call graphs: neighbours, closures, trees and paths.

Edges are (caller, callee).  Walks keep a visited set, join the new frontier alone
and materialise every round in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def call_edges(functions: DataFrame) -> DataFrame:
    """(caller, callee) of every version of every function; null ``calls`` means no calls."""
    return functions.select(F.col("name").alias("caller"), F.explode("calls").alias("callee"))


def caller_index(edges: DataFrame) -> DataFrame:
    """(callee, callers), duplicates kept.  The lists are as long as a callee is popular; joins should use the edges."""
    return edges.groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))


def entry_points(edges: DataFrame) -> DataFrame:
    """(name): those that call and are never called."""
    called = edges.select(F.col("callee").alias("name")).distinct()
    return edges.select(F.col("caller").alias("name")).distinct().join(called.hint("merge"), "name", "left_anti")


def callers(functions: DataFrame, name: str) -> DataFrame:
    """(name): distinct callers, tested on the array column without exploding it."""
    return functions.where(F.array_contains("calls", name)).select("name").distinct()


def callees(best: DataFrame, name: str) -> DataFrame:
    """(callee) of the best definition of that name."""
    return best.where(F.col("name") == name).select(F.explode("calls").alias("callee")).distinct()


#: Rows of a frontier that the driver may hold and send to all tasks.
FEW = 10_000


def _near(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that ``rows`` were counted of: sent to all tasks while they are few, else merged.

    Without this Spark goes by a size it guesses from the source's files, compressed and pruned, and sends large sides through the driver.
    """
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    forward = edges.select(F.col("caller").alias("a"), F.col("callee").alias("b"))
    backward = edges.select(F.col("callee").alias("a"), F.col("caller").alias("b"))
    return {"forward": forward, "backward": backward, "both": forward.unionByName(backward)}[direction].distinct()


def _walk(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str) -> tuple[DataFrame, int]:
    """``levels`` and how many rows they are."""
    steps = cut(_oriented(edges, direction))
    seen = cut(starts.select("name").distinct().withColumn("level", F.lit(0)))
    frontier, total = seen, seen.count()
    new = total
    for depth in range(1, max_depth + 1):
        reached = steps.join(_near(frontier.select(F.col("name").alias("a")), new), "a").select(F.col("b").alias("name")).distinct()
        frontier = cut(reached.join(_near(seen.select("name"), total), "name", "left_anti").withColumn("level", F.lit(depth)))
        new = frontier.count()
        if not new:
            break
        seen, total = seen.unionByName(frontier), total + new
    return seen, total


def levels(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "forward") -> DataFrame:
    """(name, level): the least number of calls from a start, up to ``max_depth``; the starts are level 0."""
    return _walk(edges, starts, max_depth, direction)[0]


def closure(edges: DataFrame, start: DataFrame, max_depth: int, direction: str = "forward") -> DataFrame:
    """(caller, callee): the edges that a walk of ``max_depth`` calls goes along."""
    seen, total = _walk(edges, start, max_depth, direction)
    reached = _near(seen.where(F.col("level") < max_depth).select("name"), total)
    along = lambda end: edges.join(reached.withColumnRenamed("name", end), end, "left_semi").select("caller", "callee")
    if direction == "forward":
        return along("caller").distinct()
    if direction == "backward":
        return along("callee").distinct()
    return along("caller").unionByName(along("callee")).distinct()


def tree(edges: DataFrame, start: DataFrame, depth: int, direction: str = "forward") -> DataFrame:
    """(path, name, depth): every path of up to ``depth`` calls from the starts that meets no name twice."""
    steps = cut(_oriented(edges, direction))
    level = cut(start.select("name").distinct().select(F.array("name").alias("path"), "name", F.lit(0).alias("depth")))
    out = level
    for d in range(1, depth + 1):
        level = cut(steps.join(_near(level, level.count()), F.col("name") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("name"), F.lit(d).alias("depth")))
        out = out.unionByName(level)
    return out


def limited_chain(edges: DataFrame, start: DataFrame, limit: int = 15, second: int = 3, direction: str = "forward") -> DataFrame:
    """(first, second): the first ``limit`` neighbours by name, each with up to ``second`` of its own (null where none)."""
    steps = _oriented(edges, direction)
    one = steps.join(start.select(F.col("name").alias("a")), "a").select(F.col("b").alias("first")).distinct().orderBy("first").limit(limit)
    w = Window.partitionBy("first").orderBy("second")
    two = steps.join(one, F.col("a") == F.col("first")).select("first", F.col("b").alias("second")).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= second).drop("r")
    return one.join(two, "first", "left")


def paths_to(edges: DataFrame, starts: DataFrame, target: str, max_depth: int = 10) -> DataFrame:
    """(start, path): a shortest path of at most ``max_depth`` calls from each start to the target.

    The walk goes backward from the target, so one walk serves all starts; of equally short ways the one whose next name is
    least is taken at every step.
    """
    target_df = edges.sparkSession.createDataFrame([(target,)], "name string")
    far, total = _walk(edges, target_df, max_depth, "backward")
    far = cut(far)
    w = Window.partitionBy("name").orderBy("next")
    here = far.select(F.col("name").alias("caller"), "level")
    near = far.select(F.col("name").alias("callee"), F.col("level").alias("next_level"))
    hop = edges.join(_near(here, total), "caller").join(_near(near, total), "callee").where(F.col("next_level") == F.col("level") - 1)
    hop = cut(hop.select(F.col("caller").alias("name"), F.col("callee").alias("next")).withColumn("r", F.row_number().over(w)).where("r = 1").select("name", "next"))
    walk = cut(far.join(starts.select("name").hint("merge"), "name", "left_semi").select(F.col("name").alias("start"), F.array("name").alias("path"), F.col("name").alias("at")))
    done = walk.where(F.col("at") == target)
    walk = walk.where(F.col("at") != target)
    for _ in range(max_depth):
        rows = walk.count()
        if not rows:
            break
        walk = cut(hop.join(_near(walk, rows), F.col("at") == F.col("name")).select("start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at")))
        done = done.unionByName(walk.where(F.col("at") == target))
        walk = walk.where(F.col("at") != target)
    return done.select("start", "path")


def connected_files(functions: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_path): changed files, those whose functions theirs call, and those whose functions call theirs."""
    own = functions.join(changed.select("file_path"), "file_path", "left_semi")
    names, called = own.select("name").distinct(), own.select(F.explode("calls").alias("name")).distinct()
    callees_ = functions.join(called, "name", "left_semi").select("file_path")
    edges = functions.select("file_path", F.explode("calls").alias("name"))
    return changed.select("file_path").union(callees_).union(edges.join(names, "name", "left_semi").select("file_path")).distinct()
