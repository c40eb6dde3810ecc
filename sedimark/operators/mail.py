"""Mail: search, dates and threads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.text import tokens
from .storage import placed

FIELDS = ("from", "subject", "body", "recipients", "symbols")


def _match(field: str, pattern: str) -> Column:
    p = "(?i)" + pattern
    return F.exists("symbols", lambda s: s.rlike(p)) if field == "symbols" else F.col(f"`{field}`").rlike(p)


def search(mails: DataFrame, since: int | None = None, until: int | None = None, **patterns: list[str]) -> DataFrame:
    """Any pattern of a field, all fields; ``from_`` stands for from.  Dates that can't be read (0) drop with a date filter."""
    conditions = [reduce(lambda a, b: a | b, [_match(field.rstrip("_"), p) for p in given]) for field, given in patterns.items() if given]
    date = F.col("date_timestamp")
    if since is not None or until is not None:
        conditions.append(date > 0)
    if since is not None:
        conditions.append(date >= since)
    if until is not None:
        conditions.append(date <= until)
    return mails.where(reduce(lambda a, b: a & b, conditions)) if conditions else mails


def token_index(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(token, key): the inverted index of a text column: lower case, accents folded, no stemming."""
    return texts.select(key, F.explode(F.array_distinct(tokens(F.col(column)))).alias("token"))


def having_all_tokens(index: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """(key): those that have every token; the index is filtered before it is grouped."""
    return index.where(F.col("token").isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def by_message_id(mails: DataFrame, message_id: str) -> DataFrame:
    wanted = message_id if message_id.startswith("<") else f"<{message_id}>"
    return mails.where(F.col("message_id") == wanted)


def by_subject_of(mails: DataFrame, subject: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Mails whose subject holds a commit's, newest first."""
    found = search(mails.where(F.col("subject").contains(subject)), since, until)
    return found.orderBy(F.desc("date_timestamp"), "message_id")


def reply_edges(mails: DataFrame) -> DataFrame:
    """(message_id, parent): in-reply-to and all references."""
    refs = F.split(F.trim(F.coalesce("references", F.lit(""))), r"\s+")
    edges = mails.select("message_id", F.explode(F.array_union(F.array(F.coalesce("in_reply_to", F.lit(""))), refs)).alias("parent"))
    return edges.where("parent <> '' AND parent <> message_id").distinct()


def thread_root(mails: DataFrame, start: DataFrame) -> DataFrame:
    """(message_id, root): up along in_reply_to to a mail that has none, whose parent is missing, or that was met before."""
    up = mails.select(F.col("message_id").alias("m"), F.col("in_reply_to").alias("p"))
    known = mails.select(F.col("message_id").alias("p")).distinct()
    up = cut(up.join(known, "p", "left_semi").select("m", "p"))
    walk = cut(start.select("message_id", F.col("message_id").alias("root"), F.array("message_id").alias("path")))
    done = None
    while True:
        step = walk.join(up, F.col("root") == F.col("m"), "left")
        step = cut(step.select("message_id", "root", "path", F.when(~F.array_contains("path", F.col("p")), F.col("p")).alias("p")))
        ended = step.where("p IS NULL").select("message_id", "root")
        done = ended if done is None else done.unionByName(ended)
        walk = step.where("p IS NOT NULL").select("message_id", F.col("p").alias("root"), F.array_append("path", F.col("p")).alias("path"))
        if walk.isEmpty():
            return done


def replies(mails: DataFrame, starts: DataFrame, include_starts: bool = True) -> DataFrame:
    """(message_id, depth): the starts and all mails that reply to or refer to them, directly or not."""
    edges = cut(reply_edges(mails))
    seen = cut(starts.select("message_id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while True:
        depth += 1
        found = edges.join(frontier.select(F.col("message_id").alias("parent")), "parent").select("message_id").distinct()
        frontier = cut(found.join(seen.select("message_id"), "message_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if include_starts else seen.where("depth > 0")


def cycle_roots(inside: DataFrame) -> DataFrame:
    """(message_id): the earliest mail of each circle of replies, of (child, up, part), all of which lead into circles.

    By doubling: after as many steps as there are mails everyone stands on a circle, and the least part met from there on
    the way round is the circle's first.
    """
    n = inside.count()
    at = cut(inside.groupBy("child").agg(F.min(F.struct("part", "up")).alias("x")).select("child", F.col("x.up").alias("to"), F.struct("x.part", F.col("child").alias("id")).alias("least")))
    for _ in range(max(1, n).bit_length() + 1):
        far = at.select(F.col("child").alias("middle"), F.col("to").alias("far"), F.col("least").alias("further"))
        at = cut(at.join(far, F.col("to") == F.col("middle")).select("child", F.col("far").alias("to"), F.least("least", "further").alias("least")))
    on = at.select(F.col("to").alias("child")).distinct()
    return at.join(on, "child", "left_semi").select(F.col("least.id").alias("message_id")).distinct()


def threads(mails: DataFrame) -> DataFrame:
    """(message_id, root, path): each mail's root and its way down, which sorts a thread in depth-first order.

    A root has no parent here, or is the earliest mail of a circle of replies, whose own reply then counts for nothing.
    Siblings are in the order of their time, not of their date's text.  A path holds one fixed-width part a reply.
    """
    part = F.concat(F.lpad(F.coalesce("date_timestamp", F.lit(0)).cast("string"), 12, "0"), F.lit(" "), F.col("message_id"))
    own = cut(mails.select("message_id", "in_reply_to", part.alias("part")))
    known = own.select(F.col("message_id").alias("in_reply_to")).distinct()
    inside = own.join(known, "in_reply_to", "left_semi").where("in_reply_to <> message_id")
    level = cut(own.join(inside.select("message_id"), "message_id", "left_anti").select("message_id", F.col("message_id").alias("root"), F.array("part").alias("path")))
    inside = cut(inside.select(F.col("message_id").alias("child"), F.col("in_reply_to").alias("up"), "part"))

    def down(level: DataFrame, inside: DataFrame) -> DataFrame:
        out = level
        while not level.isEmpty():
            level = cut(inside.join(level, F.col("up") == F.col("message_id")).select(F.col("child").alias("message_id"), "root", F.array_append("path", F.col("part")).alias("path")))
            out = out.unionByName(level)
        return out

    out = down(level, inside)
    left = cut(inside.join(out.select(F.col("message_id").alias("child")), "child", "left_anti"))
    if left.isEmpty():
        return out
    roots = cut(cycle_roots(left))
    first = own.join(roots, "message_id", "left_semi").select("message_id", F.col("message_id").alias("root"), F.array("part").alias("path"))
    return out.unionByName(down(cut(first), cut(left.join(roots.withColumnRenamed("message_id", "child"), "child", "left_anti"))))


def thread_order(mails: DataFrame) -> DataFrame:
    """(root, place, message_id, depth): mails of each thread in depth-first order."""
    w = Window.partitionBy("root").orderBy("path")
    return threads(mails).select("root", F.row_number().over(w).alias("place"), "message_id", (F.size("path") - 1).alias("depth"))


def by_date(mails: DataFrame, descending: bool = False) -> DataFrame:
    ts = F.col("date_timestamp")
    return mails.orderBy(ts.desc() if descending else ts.asc(), "message_id")


def placed_by_date(mails: DataFrame, descending: bool = False) -> DataFrame:
    """(message_id, date_timestamp, place from 1) of all mails."""
    ts = F.col("date_timestamp")
    return placed(mails.select("message_id", "date_timestamp"), [ts.desc() if descending else ts.asc(), F.col("message_id")])


def new_shards(have: DataFrame, offered: DataFrame) -> DataFrame:
    """(list_name, shard): shards of each mail archive beyond the newest that is there."""
    newest = have.groupBy("list_name").agg(F.max("shard").alias("newest"))
    return offered.join(newest, "list_name", "left").where(F.col("shard") > F.coalesce("newest", F.lit(-1))).select("list_name", "shard")
