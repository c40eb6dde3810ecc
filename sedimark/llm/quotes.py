"""Chat formatting by quotation linking.  DataFrame operations only.

Lines that begin with ``>`` are quoted, as deep as they have marks.  A maximal run
of lines of one depth is a passage; its normal form (lower case, runs of anything
but letters and digits as one space) is hashed, whole and by its parts: paragraphs,
lines and sentences, which wrapping doesn't change.  Originals are indexed by the same
hashes of what they say themselves.  A passage, or where it was trimmed the longest part
of it, is linked to the first message of its own conversation that says it, if that is an
earlier one, else to the first message that does anywhere; so every hash has one original
a conversation and one in all, and a phrase that everyone uses multiplies nothing.

A message replies to the original of its outermost, most wholly and longest linked passage,
and where nothing is linked to the message before it.  Messages that hang together by
replies are a thread, which the first message of a conversation begins; it is in reply
order when sorted by conversation and turn, since a reply goes to a smaller one always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns that are ordered within one task; longer conversations are put together from blocks of as many.
BLOCK_TURNS = 1024
#: Characters of a normal form below which a passage or paragraph, and a line or sentence, is looked for in its own conversation alone.
LEAST_CHARS, LEAST_PART = 12, 24

_MARKS = r"^(?:[ \t]*>)+"
_LEVEL = f"length(regexp_replace(regexp_extract(line, r'{_MARKS}', 0), '[^>]', ''))"
_ATTRIBUTION = r"(?i)^\s*(?:on\b.*\b)?\S.*\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), r'[^\p{{L}}\p{{N}}]+', ' '))"


def _lines(messages: DataFrame) -> DataFrame:
    """One row per line of those messages that quote: level, body, number of the passage."""
    lines = messages.where("text RLIKE r'(?m)^[ \\t]*>'").select("row", "conv_id", "turn", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("level", F.expr(_LEVEL)).withColumn("body", F.expr(rf"regexp_replace(line, r'{_MARKS}[ \t]?', '')"))
    own = Window.partitionBy("row").orderBy("pos")  # one message's lines
    new = F.coalesce((F.col("level") != F.lag("level").over(own)).cast("int"), F.lit(1))
    return lines.withColumn("passage", F.sum(new).over(own.rowsBetween(Window.unboundedPreceding, 0)))


def _ordered(messages: DataFrame) -> DataFrame:
    """position (from 0, in the order of turns) and the turn before, without ordering a conversation in one task."""
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK_TURNS)
    blocked = messages.withColumn("block", block)
    sums = blocked.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("k"), F.max("turn").alias("last"))
    chain = Window.partitionBy("conv_id").orderBy("block")
    offsets = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("k").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("last").over(chain).alias("carried"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "row")
    ranked = blocked.withColumn("in_block", F.row_number().over(within) - 1).withColumn("previous", F.lag("turn").over(within))
    joined = ranked.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select(*messages.columns, (F.col("offset") + F.col("in_block")).cast("long").alias("position"), F.coalesce("previous", "carried").alias("previous"))


def _units(text: str) -> str:
    """SQL: array of (rank, normal) of a text whole (3), by paragraph (2), by line and sentence (1)."""
    sentences = rf"flatten(transform(split({text}, r'\n[ \t]*\n'), p -> split(regexp_replace(p, r'\s+', ' '), r'(?<=[.!?]) ')))"
    parts = ((3, f"array({text})"), (2, rf"split({text}, r'\n[ \t]*\n')"), (1, f"split({text}, '\n')"), (1, sentences))
    every = ", ".join(f"transform({x}, u -> named_struct('rank', {rank}, 'normal', {_normal('u')}))" for rank, x in parts)
    return f"filter(concat({every}), u -> u.normal <> '')"


def _key(conv: Column, turn: Column) -> Column:
    return F.concat(F.coalesce(conv.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit("-")))


def _threads(messages: DataFrame) -> DataFrame:
    """(row, thread_conv, depth) of messages (row, conv_id, turn, position, to: what a quotation replies to).

    Between quotations a conversation is a run in which each message replies to the one before, so only runs take part
    in the walk up to the root.  It goes by doubling, in as many rounds as the longest way has binary digits.
    """
    head = F.when(F.col("to").isNotNull() | (F.col("position") == 0), F.col("position"))
    blocked = messages.withColumn("head", head).withColumn("block", F.expr(f"position div {BLOCK_TURNS}"))
    chain = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocked.groupBy("conv_id", "block").agg(F.max("head").alias("h")).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.max("h").over(chain).alias("carried"))
    within = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    runs = blocked.withColumn("inner", F.max("head").over(within)).join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    runs = cut(runs.select("row", "conv_id", "turn", "position", "to", F.coalesce("inner", "carried").alias("run")))
    quoting = runs.where("to IS NOT NULL").select(_key(F.col("conv_id"), F.col("position")).alias("run"), _key(F.col("to.conv"), F.col("to.turn")).alias("target"))
    said = runs.groupBy("conv_id", "turn").agg(F.min(F.struct("position", "run")).alias("x"))
    said = said.select(_key(F.col("conv_id"), F.col("turn")).alias("target"), F.col("conv_id").alias("up_conv"), _key(F.col("conv_id"), F.col("x.run")).alias("up"), (F.col("x.position") - F.col("x.run") + 1).alias("steps"))
    at = cut(quoting.join(said, "target").select("run", "up", "up_conv", "steps"))
    while True:
        far = at.select(F.col("run").alias("middle"), F.col("up").alias("far"), F.col("up_conv").alias("far_conv"), F.col("steps").alias("more"))
        joined = at.join(far, F.col("up") == F.col("middle"), "left")
        at = cut(joined.select("run", F.coalesce("far", "up").alias("up"), F.when(F.col("middle").isNotNull(), F.col("far_conv")).otherwise(F.col("up_conv")).alias("up_conv"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("middle").isNotNull().alias("moved")))
        moved, at = at.where("moved"), at.drop("moved")
        if moved.isEmpty():
            break
    roots = at.select(F.col("run").alias("key"), "up_conv", "steps")
    keyed = runs.withColumn("key", _key(F.col("conv_id"), F.col("run"))).join(roots, "key", "left")
    return keyed.select("row", F.when(F.col("steps").isNotNull(), F.col("up_conv")).otherwise(F.col("conv_id")).alias("thread_conv"), (F.coalesce("steps", F.lit(0)) + F.col("position") - F.col("run")).alias("depth"))


def _placed(messages: DataFrame) -> DataFrame:
    """place: from 0, in a thread's order by conversation and position, without ordering a thread in one task."""
    blocked = messages.withColumn("block", F.expr(f"position div {BLOCK_TURNS}"))
    chain = Window.partitionBy("thread_conv").orderBy(F.col("conv_id").asc_nulls_first(), "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("thread_conv", "conv_id", "block").agg(F.count(F.lit(1)).alias("k"))
    before = sums.select(F.col("thread_conv").alias("t"), F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("k").over(chain), F.lit(0)).alias("before"))
    within = Window.partitionBy("thread_conv", "conv_id", "block").orderBy("position")
    ranked = blocked.withColumn("in_block", F.row_number().over(within) - 1)
    joined = ranked.join(before, F.col("thread_conv").eqNullSafe(F.col("t")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select(*messages.columns, (F.col("before") + F.col("in_block")).alias("place"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position, reply_conv, reply_turn, linked_by, thread_conv, depth, place, quotes, linked, deepest, text, formatted.

    position: place in the conversation, from 0; linked_by: ``quote``, ``previous`` or ``none``; thread_conv: the
    conversation whose first message all replies from here lead up to; depth: how many they are; place: place in the
    thread, from 0, where every reply follows what it replies to; quotes: passages quoted; linked: those that were found;
    deepest: deepest level; text: the message without quotations and the lines that announce them; formatted: text between
    its role's marks.  A thread's messages by place are the conversation in reply order.

    Null texts are empty, null roles ``unknown``, null turns come first; messages whose conv_id is null make one
    conversation, which is before all others.  Messages that repeat stay, in any order among themselves; a reply goes to
    the first of them.  An empty table gives an empty one.  Texts are read whole.  Only conv_id, turn, role and text are
    read.
    """
    own = conversations.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = cut(own)  # the rows keep their numbers whatever the input is
    lines = cut(_lines(own))
    gather = F.expr("array_join(transform(array_sort(collect_list(struct(pos, body))), x -> x.body), '\n')")
    passages = lines.groupBy("row", "conv_id", "turn", "passage", "level").agg(gather.alias("body"), F.expr("array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), '\n')").alias("raw"))
    quoted = passages.where("level > 0")
    said = passages.where("level = 0").groupBy("row").agg(F.expr("array_join(transform(array_sort(collect_list(struct(passage, raw))), x -> x.raw), '\n')").alias("said"))
    announced = F.expr(rf"array_join(filter(split(said, '\n'), x -> NOT x RLIKE r'{_ATTRIBUTION}'), '\n')")
    clean = F.expr(r"regexp_replace(regexp_replace(said, r'\n{3,}', '\n\n'), r'^\s+|\s+$', '')")
    quoting = said.select("row", announced.alias("said")).select("row", clean.alias("clean"))
    rows_quoting = lines.select("row").distinct().withColumn("quoting", F.lit(True))
    texts = own.join(rows_quoting, "row", "left").join(quoting, "row", "left").withColumn("clean", F.when(F.col("quoting"), F.coalesce("clean", F.lit(""))).otherwise(F.expr(r"regexp_replace(text, r'^\s+|\s+$', '')")))
    texts = cut(texts.select("row", "conv_id", "turn", "role", F.col("clean").alias("text")))

    # Originals: what a message says itself, whole and by its parts.  Only hashes that some quotation has matter.
    hash_ = lambda normal: F.unhex(F.sha2(normal, 256))
    units = quoted.select("row", "conv_id", "turn", "passage", "level", F.explode(F.expr(_units("body"))).alias("u"))
    wanted = cut(units.select("row", "conv_id", "turn", "passage", "level", "u.rank", F.length("u.normal").alias("size"), hash_(F.col("u.normal")).alias("hash")))
    said_units = F.transform(F.expr(f"array_distinct(transform({_units('text')}, u -> u.normal))"), hash_)
    originals = texts.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.explode(said_units).alias("hash"))
    originals = cut(originals.join(wanted.select("hash").distinct(), "hash", "left_semi").groupBy("to_conv", "hash").agg(F.min("to_turn").alias("to_turn"), F.max(F.col("to_turn").isNull()).alias("none")))
    # A null turn is before all others, as in an ordering of structs.
    originals = originals.select("to_conv", "hash", F.when(~F.col("none"), F.col("to_turn")).alias("to_turn"))
    where = lambda x: F.struct(F.col(f"{x}conv"), F.col(f"{x}turn"))
    w = wanted.select("row", F.col("conv_id").alias("conv"), "turn", "passage", "level", "rank", "size", "hash")
    here = w.join(originals.withColumnRenamed("hash", "h"), (F.col("hash") == F.col("h")) & F.col("conv").eqNullSafe(F.col("to_conv")))
    here = here.where(F.struct("to_turn") < F.struct("turn")).withColumn("near", F.lit(1))
    first = originals.groupBy("hash").agg(F.min(F.struct("to_conv", "to_turn")).alias("f")).select("hash", "f.to_conv", "f.to_turn")
    there = w.where(f"size >= IF(rank = 1, {LEAST_PART}, {LEAST_CHARS})").join(first, "hash")
    there = there.where(~F.col("to_conv").eqNullSafe(F.col("conv")) & (where("to_") < F.struct("conv", "turn"))).withColumn("near", F.lit(0))
    links = here.drop("h").unionByName(there)
    best = links.groupBy("row").agg(F.max_by(F.struct(F.col("to_conv").alias("conv"), F.col("to_turn").alias("turn")), F.struct(-F.col("level"), "rank", "near", "size", "passage")).alias("to"), F.count_distinct("passage").alias("linked"))
    counted = quoted.groupBy("row").agg(F.count(F.lit(1)).alias("quotes"), F.max("level").alias("deepest"))
    ordered = cut(_ordered(texts).join(best, "row", "left").join(counted, "row", "left"))
    threads = _threads(ordered.select("row", "conv_id", "turn", "position", "to"))
    out = _placed(ordered.join(threads, "row"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", "turn", "role", "position",
        F.when(F.col("to").isNotNull(), F.col("to.conv")).when(F.col("position") > 0, F.col("conv_id")).alias("reply_conv"),
        F.when(F.col("to").isNotNull(), F.col("to.turn")).otherwise(F.col("previous")).alias("reply_turn"),
        F.when(F.col("to").isNotNull(), "quote").when(F.col("position") > 0, "previous").otherwise("none").alias("linked_by"),
        "thread_conv", F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"),
        zero("quotes"), zero("linked"), zero("deepest"), "text",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")).alias("formatted"),
    )
