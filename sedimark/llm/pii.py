"""Personal data: exact expressions first, then bootstrapped contextual extraction.  DataFrame operations only.

*Base.*  Of each kind the leftmost non-overlapping matches that pass a test.  The
expressions are written so that a long run of digits or letters is read once: a
match can only begin where a run begins, and runs are never given back.

*Bootstrap.*  Tokens of five characters or more that hold a digit or ``@`` are
candidates.  A candidate that overlaps a base match is a seed.  Its lexical patterns
are, each with the kind of token that it is, the word before it, the word after it,
and the two together (of up to 64 characters on either side).  In rounds, until none
is added, a pattern's confidence is the mean confidence of its distinct instances
(shrunk by one doubtful instance), patterns with too few sure instances, or more
doubtful than sure, count for nothing, and an instance that is no seed is as sure as
the noisy-or of its patterns in the family (before, after, both) that speaks most for
it.  Instances that end above ``accept`` are identifiers, wherever they stand; their
spans are of kind ``context`` and come beside the base ones.  A candidate that has a
base kind's form and failed its test (a number that is no card) was judged already: it
speaks against its patterns and is never accepted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # A maximal run of digits with single separators is one match of the base expression; those of 16 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "candidate": r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{5,}+",
}
_GUARDS = {"email": "contains(t, '@')", "ip": "t RLIKE r'[0-9]\\.[0-9]'", "card": "t RLIKE r'[0-9](?:[\\x20-]?[0-9]){15}'", "phone": "contains(t, '+')", "candidate": "t RLIKE '[0-9@]'"}


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


_LUHN = _let("d", _digits("s.value"), "aggregate(sequence(1, length(d)), 0, (a, i) -> a + IF((length(d) - i) % 2 = 0, int(substr(d, i, 1)), IF(int(substr(d, i, 1)) > 4, 2 * int(substr(d, i, 1)) - 9, 2 * int(substr(d, i, 1))))) % 10 = 0")
_TESTS = {
    "ip": "forall(split(s.value, r'\\.'), p -> length(ltrim('0', p)) <= 3 AND int(right(concat('000', p), 3)) <= 255)",
    "card": f"length({_digits('s.value')}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_digits('s.value')}) BETWEEN 8 AND 15",
}

#: Matches whose lengths are added up at once; places are then linear in the matches but for (matches / BLOCK) squared.
_BLOCK = 64


def _spans(kind: str) -> str:
    """SQL over ``t``: an array of (start, end, value, before, after), in code points, end exclusive."""
    rx = "r'" + _EXPRESSIONS[kind] + "'"
    before, after = ("substring(z.g[i], greatest(1, length(z.g[i]) - 63), 64)", "substring(z.g[i + 1], 1, 64)") if kind == "candidate" else ("''", "''")
    at = f"y.b[i div {_BLOCK}] + aggregate(slice(y.l, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, v) -> a + v) + length(z.g[i])"
    cell = f"named_struct('start', p, 'end', p + length(x), 'value', x, 'before', {before}, 'after', {after})"
    cells = f"transform(z.m, (x, i) -> {_let('p', at, cell)})"
    sums = f"transform(sequence(0, (size(l) - 1) div {_BLOCK}), k -> aggregate(slice(l, k * {_BLOCK} + 1, {_BLOCK}), 0, (a, v) -> a + v))"
    earlier = _let("s", sums, "transform(s, (v, k) -> aggregate(slice(s, 1, k), 0, (a, w) -> a + w))")
    with_sums = _let("l", "transform(z.m, (x, i) -> length(z.g[i]) + length(x))", _let("y", f"named_struct('l', l, 'b', {earlier})", cells))
    found = _let("z", f"named_struct('g', split(t, {rx}, -1), 'm', regexp_extract_all(t, {rx}, 0))", with_sums)
    test = f"filter({found}, s -> {_TESTS[kind]})" if kind in _TESTS else found
    return f"CASE WHEN {_GUARDS[kind]} THEN {test} ELSE array() END"


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns, and an array of spans for each kind and for the candidates of the bootstrap."""
    texts = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return texts.select(*keep, *(F.expr(_spans(kind)).alias(kind) for kind in (*KINDS, "candidate")))


def _overlaps(kind: str) -> str:
    return f"exists({kind}, s -> s.start < c.end AND c.start < s.end)"


_SHAPE = "CASE WHEN contains(value, '@') THEN 'address' WHEN value RLIKE r'\\p{L}' THEN 'mixed' ELSE 'number' END"
_WORD = "regexp_replace(lower({}), '[0-9]', '0')"
#: What has the form of a base kind as a whole.
_JUDGED = r"value RLIKE r'^[^0-9+]*(?:[0-9](?:[\x20-]?[0-9]){15,18}|[0-9]+(?:\.[0-9]+){3}|\+[0-9][\x20().0-9-]+[0-9])[^0-9]*$'"


def discovered(found: DataFrame, rounds: int = 8, least: int = 3, accept: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(row, start, end, value) of all candidates that no base span overlaps, and the values that are identifiers.

    ``rounds`` is a bound; the iteration ends as soon as a round adds nothing.
    """
    seed = " OR ".join(map(_overlaps, KINDS))
    occurrences = found.where("size(candidate) > 0").selectExpr("row", "explode(transform(candidate, c -> named_struct('start', c.start, 'end', c.end, 'value', c.value, 'before', c.before, 'after', c.after, 'seed', " + seed + "))) AS c").select("row", "c.*")
    words = occurrences.select("row", "start", "end", "value", "seed", F.expr(_SHAPE).alias("shape"), F.expr(_WORD.format("regexp_extract(before, r'(?<!\\S)(\\S++)\\s*$', 1)")).alias("left"), F.expr(_WORD.format("regexp_extract(after, r'^\\s*(\\S+)', 1)")).alias("right"))
    words = cut(words)
    named = lambda family, *parts: F.struct(F.lit(family).alias("family"), F.concat_ws(" ", F.lit(family), "shape", *parts).alias("pattern"))
    families = F.explode(F.array(named("before", "left"), named("after", "right"), named("both", "left", F.lit("_"), "right")))
    # A pattern of no word at all (the edge of a text) says nothing.
    edges = words.select("value", "seed", families.alias("f"), "left", "right").where("f.family = 'before' AND left <> '' OR f.family = 'after' AND right <> '' OR f.family = 'both' AND left <> '' AND right <> ''")
    edges = edges.groupBy("f.family", "f.pattern", "value").agg(F.max("seed").alias("seed"))
    # A value that is a seed anywhere is one everywhere.
    sure = words.groupBy("value").agg(F.max("seed").alias("sure"))
    edges = cut(edges.select("family", "pattern", "value").join(sure.select("value", "sure", (~F.col("sure") & F.expr(_JUDGED)).alias("judged")), "value"))
    scored, accepted = edges.withColumn("confidence", F.col("sure").cast("double")), 0
    sound = F.col("confidence") >= accept
    for _ in range(rounds):
        by_pattern = scored.groupBy("pattern").agg((F.sum("confidence") / (F.count(F.lit(1)) + 1)).alias("c"), F.sum(sound.cast("int")).alias("k")).where((F.col("k") >= least) & (F.col("c") >= 0.5)).select("pattern", "c")
        doubt = edges.where("NOT sure AND NOT judged").join(by_pattern, "pattern").groupBy("value", "family").agg((1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(1 - 1e-9)))))).alias("found"))
        doubt = doubt.groupBy("value").agg(F.max("found").alias("found"))
        scored = cut(edges.join(doubt, "value", "left").select("family", "pattern", "value", "sure", F.when(F.col("sure"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("confidence")))
        now = scored.where(~F.col("sure") & sound).select(F.count_distinct("value")).head()[0]
        if now <= accepted:
            break
        accepted = now
    values = scored.where(~F.col("sure") & sound).select("value").distinct()
    return words.where(~F.col("seed")).select("row", "start", "end", "value"), values


def personal_data(docs: DataFrame, rounds: int = 8, least: int = 3, accept: float = 0.8) -> DataFrame:
    """row, doc_id, and arrays of spans: email, ip, card, phone, context; one row per row of ``docs``.

    Null is the empty text.  Rows that repeat stay, null ids too; an empty table gives an empty one.  Only doc_id and
    text are read.  ``row`` numbers the rows as ``monotonically_increasing_id`` does for the same input, which must be
    one that is read alike each time (a written table), as a stage's is.
    """
    found = cut(base_spans(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "row", "doc_id"))
    candidates, values = discovered(found, rounds, least, accept)
    added = candidates.join(values, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("context"))
    own = [F.expr(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end))").alias(k) for k in KINDS]
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    return found.select("row", "doc_id", *own).join(added, "row", "left").withColumn("context", F.coalesce("context", empty))


def _names(kind: str) -> str:
    return f"transform({kind}, s -> concat('{kind}:', s.start, ':', s.end))"


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of what ``personal_data`` found."""
    base = f"array_join(concat({', '.join(map(_names, KINDS))}), ',')"
    every = f"array_join(concat({', '.join(map(_names, (*KINDS, 'context')))}), ',')"
    return spans.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(every).alias("spans"), F.size("context").cast("long").alias("n_context"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every character of every span of its texts replaced.

    Spans that overlap or touch within one another are masked together, by the kind of the longest of them (of equal ones
    the first) in brackets.  Texts without a span are untouched, null ones included; rows that repeat stay.  Other columns
    stay as they are, whatever their names.  ``docs`` must be read alike each time.
    """
    spans = personal_data(docs)
    every = F.expr("explode(concat(" + ", ".join(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'kind', '{k}'))" for k in (*KINDS, "context")) + "))")
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)  # one document's spans
    flat = spans.select("row", every.alias("s")).select("row", "s.*")
    runs = flat.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    union = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct(F.col("start") - F.col("end"), "start", "kind")).alias("kind"))
    own, mask = (f"{x}_{uuid.uuid4().hex}" for x in ("row", "mask"))
    masks = union.groupBy(F.col("row").alias(own)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(mask))
    numbered = docs.withColumn(own, F.monotonically_increasing_id())
    piece = f"substring(text, IF(i = 0, 1, {mask}[i - 1].end + 1), s.start - IF(i = 0, 0, {mask}[i - 1].end))"
    masked = F.expr(f"concat(array_join(transform({mask}, (s, i) -> concat({piece}, '[', upper(s.kind), ']')), ''), substring(text, element_at({mask}, -1).end + 1))")
    joined = numbered.join(masks, own, "left")
    return joined.select(*(F.when(F.col(mask).isNotNull(), masked).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
