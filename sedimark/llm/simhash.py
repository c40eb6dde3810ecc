"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at up to three differing bits.  Cut into two halves
of 32 bits, linked fingerprints differ by at most one bit in one of them.  The
anchors of a half are the words of a covering code: the perfect [31, 26] Hamming
code beside one free bit, 2**27 anchors with covering radius 1.  The home anchor
of a half-fingerprint is within that radius; a partner that differs by one bit is
within radius + threshold = 2 of the same anchor.  So every distinct fingerprint is
replicated to all anchors within 2 (17 at most, 16.5 on average, for each half) and
links are found by comparing the fingerprints of one anchor, whole fingerprints and
not halves.  Of an anchor's links a spanning forest is emitted, never all pairs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bucketed, cut
from .components import components

THRESHOLD = 3
SEED = 42
#: Shingles that are hashed before their bits are counted.
SHINGLES = 1 << 16
#: Fingerprints of one anchor above which the other half's bytes narrow the comparison down.
DENSE = 2048


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of up to 255 ones fit a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def _stretches(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about that size which end between words."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The hashes themselves, and further independent bits mixed from them."""
    out = [hashes]
    for lane in range(1, lanes):
        z = hashes + np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out)


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the ``width``-word shingles of a UTF-8 text with A-Z lower-cased, in blocks; of fewer words the whole."""
    from xxhash import xxh64_intdigest

    carry: list[bytes] = []
    some = False
    for part in _stretches(text):
        words = carry + part.lower().split()
        if len(words) >= width:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
            ends = ends[width - 1 :].tolist()
            for i in range(0, len(starts), SHINGLES):
                yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + SHINGLES], ends[i : i + SHINGLES])], np.uint64)
            carry = words[-(width - 1) :] if width > 1 else []
        else:
            carry = words
    if carry and not some:
        yield np.array([xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def sketch(text: bytes, width: int, lanes: int = 1) -> list[int]:
    """``lanes`` fingerprints of 64 bits; a bit is set where it is in more than half of the shingles' hashes."""
    counts, total = np.zeros((lanes, 64), np.int64), 0
    for hashes in shingle_hashes(text, width):
        for lane, values in enumerate(_lanes(hashes, lanes)):
            counts[lane] += _bit_counts(values)
        total += len(hashes)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of the ``width``-word shingles; the words' separators are ASCII white space, no word gives zero."""
    return sketch(text, width)[0]


class _Fingerprints:
    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = np.array([fingerprint(t or b"", self.width) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["row", "doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3, row: Column | None = None) -> DataFrame:
    """(row, doc_id, fp: the fingerprint's bits as a signed long) of every row; null is the empty text."""
    row = row if row is not None else F.lit(None)
    own = docs.select(row.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(_Fingerprints(width), "row long, doc_id long, fp long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: the exclusive or of the one-based places of ones."""
    s = np.zeros(x.shape, np.uint64)
    for bit, mask in enumerate(sum(1 << (place - 1) for place in range(1, 32) if place >> bit & 1) for bit in range(5)):
        s |= (np.bitwise_count(x & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(bit)
    return s


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the changes of up to two bits that lead to a code word, the nearest first; how many there are."""
    free, table, many = 1 << 31, np.zeros((32, 17), np.uint64), np.zeros(32, np.int64)
    for s in range(32):
        own = [0, free] if not s else [1 << (s - 1), 1 << (s - 1) | free, *(1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s)]
        table[s, : len(own)], many[s] = own, len(own)
    return table, many


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, many = _flips()
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for start in range(0, len(fp), 20_000):
            part = fp[start : start + 20_000]
            for half in range(2):
                x = (part.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                s = _syndromes(x)
                n = many[s]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchor = np.repeat(x, n) ^ table[np.repeat(s, n), place] | np.uint64(half << 32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.repeat(part, n)), pa.array(place == 0)], ["anchor", "fp", "home"])


def spanning_links(fps: np.ndarray, threshold: int = THRESHOLD, other: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints.

    Many fingerprints at once are narrowed down by the bytes of the half that the anchor isn't of (``other``): three
    differing bits leave one of its four bytes as it is.
    """
    if len(fps) > DENSE and other is not None:
        parts = [np.split(o := np.argsort(k, kind="stable"), np.flatnonzero(np.diff(k[o])) + 1) for k in ((fps >> np.uint64(32 * other + 8 * i)) & np.uint64(255) for i in range(4))]
        found = [spanning_links(fps[p], threshold) for by_byte in parts for p in by_byte if len(p) > 1]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    left, right, rest = [], [], fps
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), x, np.uint64))
                right.append(new)
                frontier.extend(new)
                rest = rest[~near]
    empty = np.empty(0, np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by anchor; an anchor that no fingerprint has as its home can have no link of its own."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        use = (size > 1) & (np.bincount(group, home) > 0)
        left, right = [], []
        starts = np.flatnonzero(first)
        small = use & (size <= 16)
        rows = np.flatnonzero(small[group])  # most groups by far: all their pairs, compared at one distance after another
        for k in range(1, 16):
            rows = rows[rows + k < len(fp)]
            rows = rows[group[rows + k] == group[rows]]
            if not len(rows):
                break
            hit = rows[np.bitwise_count(fp[rows] ^ fp[rows + k]) <= THRESHOLD]
            left.append(fp[hit])
            right.append(fp[hit + k])
        for g in np.flatnonzero(use & ~small):
            a, b = spanning_links(fp[starts[g] : starts[g] + size[g]], other=1 - int(anchor[starts[g]] >> 32))
            left.append(a)
            right.append(b)
        empty = np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [empty]).view(np.int64)) for x in (left, right)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        home = batch.column(2).to_numpy(zero_copy_only=False)
        cut_at = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
        if cut_at:
            held.append((anchor[:cut_at], fp[:cut_at], home[:cut_at]))
            yield found(*map(np.concatenate, zip(*held)))
            held = []
        held.append((anchor[cut_at:], fp[cut_at:], home[cut_at:]))
    if held:
        yield found(*map(np.concatenate, zip(*held)))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever links connect, among the distinct fingerprints of column fp."""
    at = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, fp long, home boolean")
    return at.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long")


def _grouped(docs: DataFrame, width: int, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and of each distinct fingerprint its least doc_id and the root of its component."""
    prints = cut(fingerprints(docs, width, row))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(fingerprint_links(distinct))
    return prints, cut(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the row's own included; null ids take part, and give
    null where no other id is reachable.  Texts without a word (null, empty) have fingerprint zero and link like any
    other.  Rows that repeat stay as they are.  An empty table gives an empty one; only doc_id and text are read.

    Copies meet in one distinct fingerprint before any comparison, by an aggregate that runs on the map side first.
    """
    prints, roots = _grouped(docs, width)
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = roots.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Candidates of the similarity search: distinct shingles of two words, four fingerprints, at most so many bits of 64 apart.
CANDIDATE_WIDTH, LANES, CANDIDATE_BITS = 2, 4, 12
#: And of all four fingerprints' 256 bits: texts at a similarity of 0.8 are 25 bits apart where edits are scattered, 39 where they
#: are in one place, with a deviation of 6; strangers are 128 apart.
SKETCH_BITS = 56
#: Rows of one anchor up to which all their candidate pairs are named.
CROWD = 32
#: Rows of one anchor that a worker compares at once.
SLICE = 4096
#: Pairs of one row above which it meets its partners in several tasks.
HUB = 10_000
#: Rounds in which every row's most promising pair alone is compared, before all that are left.
ROUNDS = 2


def _words_hash(text: bytes) -> int:
    """Of the words alone: texts that share it have the same shingles of any width."""
    from xxhash import xxh64

    h = xxh64(seed=SEED)
    for part in _stretches(text):
        if words := part.lower().split():
            h.update(b" ".join(words) + b" ")
    return h.intdigest()


def distinct_shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, width)]))


def set_sketch(text: bytes, width: int, lanes: int) -> list[int]:
    """As ``sketch``, of the distinct shingles: a passage that is repeated counts once, as it does in a similarity of sets."""
    hashes = distinct_shingles(text, width)
    counts = np.zeros((lanes, 64), np.int64)
    for i in range(0, len(hashes), SHINGLES):
        for lane, values in enumerate(_lanes(hashes[i : i + SHINGLES], lanes)):
            counts[lane] += _bit_counts(values)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


class _Sketches:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = np.array([[*set_sketch(t or b"", CANDIDATE_WIDTH, LANES), _words_hash(t or b"")] for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, i]) for i in range(LANES + 1))], ["row", "doc_id", *(f"l{i}" for i in range(LANES)), "words"])


def _to_anchors_of_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, many = _flips()
    for batch in batches:
        row = batch.column(0).to_numpy(zero_copy_only=False)
        for lane in range(LANES):
            fp = batch.column(1 + lane).to_numpy(zero_copy_only=False)
            for start in range(0, len(fp), 20_000):
                part, ids = fp[start : start + 20_000], row[start : start + 20_000]
                for half in range(2):
                    x = (part.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                    s = _syndromes(x)
                    n = many[s]
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    anchor = np.repeat(x, n) ^ table[np.repeat(s, n), place] | np.uint64((2 * lane + half) << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.repeat(part, n)), pa.array(np.repeat(ids, n))], ["anchor", "fp", "row"])


def _forest(fp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A spanning forest of candidate pairs (a, b, bits), grown from the row in the middle of all, and that row's place.

    The middle is nearest to what most bits of all rows say: of a document and its copies that is the document.
    """
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    middle = np.packbits(2 * bits > len(fp), bitorder="little").view(np.uint64)[0]
    order = np.argsort(np.bitwise_count(fp ^ middle), kind="stable")
    rest, out = order, []
    while len(rest) > 1:
        frontier, rest = deque([rest[0]]), rest[1:]
        while frontier and len(rest):
            x = frontier.popleft()
            apart = np.bitwise_count(fp[rest] ^ fp[x])
            near = apart <= CANDIDATE_BITS
            new, rest = rest[near], rest[~near]
            out.append((np.full(len(new), row[x]), row[new], apart[near].astype(np.int32)))
            frontier.extend(new)
    a, b, d = map(np.concatenate, zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
    return a, b, d, int(order[0])


class _AtAnchors:
    """Candidate pairs (null, a, b, bits) of the rows (anchor, fp, row) that stream by, sorted by anchor.

    Of up to ``CROWD`` rows of an anchor these are all candidate pairs.  A larger crowd gives spanning forests of its
    slices and of the slices' middles, and names its rows (anchor, row, null, null).
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, middles = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on in the next batch
            if last:
                yield from self.closed([c[:last] for c in held], middles)
                held, middles = [c[last:] for c in held], []
            while len(held[0]) > SLICE:
                yield from self.crowd([c[:SLICE] for c in held], middles)
                held = [c[SLICE:] for c in held]
        if held is not None:
            yield from self.closed(held, middles)

    def closed(self, held: list[np.ndarray], middles: list) -> Iterator[pa.RecordBatch]:
        """Whole anchors, of the first of which slices may have gone before."""
        if middles:
            n = int(np.searchsorted(held[0], held[0][0], "right"))
            yield from self.crowd([c[:n] for c in held], middles)
            fps, rows = np.array([m[0] for m in middles], np.uint64), np.array([m[1] for m in middles], np.int64)
            for i in range(0, len(fps), SLICE):
                yield self.pairs(*_forest(fps[max(0, i - 1) : i + SLICE], rows[max(0, i - 1) : i + SLICE])[:3])
            held = [c[n:] for c in held]
        anchor, fp, row = held
        if not len(anchor):
            return
        first = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        size = np.bincount(group)
        out = []
        at = np.flatnonzero((size <= CROWD)[group])
        for k in range(1, CROWD):
            at = at[at + k < len(fp)]
            at = at[group[at + k] == group[at]]
            if not len(at):
                break
            apart = np.bitwise_count(fp[at] ^ fp[at + k])
            near = apart <= CANDIDATE_BITS
            out.append((row[at[near]], row[at[near] + k], apart[near].astype(np.int32)))
        if out:
            yield self.pairs(*map(np.concatenate, zip(*out)))
        for g in np.flatnonzero(size > CROWD):
            yield from self.crowd([c[starts[g] : starts[g] + size[g]] for c in held], [])

    def crowd(self, part: list[np.ndarray], middles: list) -> Iterator[pa.RecordBatch]:
        anchor, fp, row = part
        a, b, d, middle = _forest(fp, row)
        middles.append((fp[middle], row[middle]))
        yield self.pairs(a, b, d)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(row), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32())], ["anchor", "a", "b", "bits"])

    @staticmethod
    def pairs(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["anchor", "a", "b", "bits"])


class _Shingles:
    """The distinct shingles' hashes of each text, sorted."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            sets = [distinct_shingles(t or b"", self.width).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["row", "shingles"])


class _Similar:
    """Whether the shingle sets of a pair overlap enough, as sets."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= self.similarity * max(len(x), len(y)) else -1
                good.append(both >= self.similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])


def _compared(chosen: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those of the pairs whose sets are similar.  A row of very many pairs meets its partners in several tasks."""
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    ends = chosen.select(F.col("a").alias("row")).unionByName(chosen.select(F.col("b").alias("row")))
    hubs = cut(ends.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("tasks")).where("tasks > 1"))
    test = lambda df: df.select("a", "b", "x", "y").mapInArrow(_Similar(similarity), "a long, b long")
    if hubs.isEmpty():
        return test(chosen.join(y, "b").join(x, "a"))
    own = lambda end: hubs.select(F.col("row").alias(end), F.lit(True).alias(f"hub_{end}"))
    marked = chosen.join(own("a"), "a", "left").join(own("b"), "b", "left")
    turned = F.col("hub_b").isNotNull() & F.col("hub_a").isNull()
    marked = cut(marked.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), (F.col("hub_a").isNotNull() | F.col("hub_b").isNotNull()).alias("hub")))
    tasks = hubs.withColumnRenamed("row", "a")
    spread = marked.where("hub").join(y, "b").join(tasks, "a").withColumn("task", F.pmod(F.xxhash64("b"), "tasks").cast("int")).drop("tasks")
    copies = x.join(tasks, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    found = test(marked.where("NOT hub").join(y, "b").join(x, "a")).unionByName(test(spread.join(copies, ["a", "task"])))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _joining(pairs: DataFrame, sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """``links`` and those of ``pairs`` (a, b, bits) that are similar, but for pairs whose rows are in one group without them.

    First each row's most promising pair is compared alone: what that joins needs no further comparison.  So the
    comparisons of a crowd of copies are as many as its rows, and only pairs that stay apart are compared one and all.
    """
    both = lambda df: df.select(F.col("a").alias("row"), F.struct("bits", "a", "b").alias("pair")).unionByName(df.select(F.col("b").alias("row"), F.struct("bits", "a", "b").alias("pair")))
    for turn in range(ROUNDS + 1):
        if pairs.isEmpty():
            break
        chosen = pairs.select("a", "b") if turn == ROUNDS else cut(both(pairs).groupBy("row").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct())
        links = cut(links.unionByName(_compared(chosen, sets, similarity)))
        if turn == ROUNDS or (rest := cut(pairs.join(chosen, ["a", "b"], "left_anti"))).isEmpty():
            break
        roots = cut(components(links))
        at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))  # noqa: B023, E731
        apart = rest.join(at("a"), "a", "left").join(at("b"), "b", "left")
        pairs = cut(apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "bits"))
    return links


def _crowded_pairs(crowds: DataFrame, sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame | None:
    """(a, b, bits): of the crowds (anchor, row) that links leave in several groups, all pairs that can be similar.

    An exact prefix filter: with shingles from the rarest to the most common, similar sets share one of their first
    few, and what is left behind the first shared one must be enough.  None where no crowd is left apart.
    """
    grouped = crowds.join(components(links), F.col("row") == F.col("node"), "left").select("anchor", "row", F.coalesce("root", "row").alias("root"))
    split = grouped.groupBy("anchor").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("anchor")
    rows = cut(grouped.join(split, "anchor", "left_semi").select("row", "root").distinct())
    if rows.isEmpty():
        return None
    shingles = rows.join(sets, "row").select("row", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    least = similarity / (1 + similarity)
    ordered = shingles.join(common, "s").groupBy("row", "root", "n").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("all"))  # one document's shingles
    first = ordered.select("row", "root", "n", F.posexplode(F.expr(f"slice(all, 1, n - int(ceil({similarity} * n - 1e-6)) + 1)")).alias("i", "t")).where("t.k > 1").select("row", "root", "n", "i", "t.s")
    first = cut(first)
    short = first.where(f"n - i >= {2 * least} * n - 1e-6")
    x, y = (df.toDF(f"row_{e}", f"root_{e}", f"n_{e}", f"i_{e}", "s") for e, df in (("x", short), ("y", first)))
    fits = f"root_x <> root_y AND (n_x < n_y OR n_x = n_y AND row_x < row_y) AND n_x >= {similarity} * n_y - 1e-6 AND least(n_x - i_x, n_y - i_y) >= {least} * (n_x + n_y) - 1e-6"
    return x.join(y, "s").where(fits).select(F.least("row_x", "row_y").alias("a"), F.greatest("row_x", "row_y").alias("b"), F.lit(0).alias("bits")).distinct()


def similar_links(docs: DataFrame, row: Column, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((row, doc_id), links (a, b) that group all rows whose sets of ``words``-word shingles have that Jaccard similarity or more).

    Candidates share an anchor in one of eight half-fingerprints, lie within ``CANDIDATE_BITS`` there and within ``SKETCH_BITS``
    in all fingerprints together; they are compared exactly, on whole texts.  Both rows of a pair go to all anchors within two bits, so halves up to two bits apart are
    sure to meet (the bit between them has its own anchor within one), and one in six of those three or four bits apart do.
    Fingerprints are of the distinct two-word shingles, which few edits disturb least.  Where an anchor is crowded,
    ``_crowded_pairs`` finds whatever pairs spanning forests leave out, exactly; so among candidates no link is missing
    that would join two groups.

    ``row`` must number the rows alike in every reading of ``docs``, and be unique.  Rows of the same words (hash and all
    fingerprints alike) are linked as they are.  Null and empty texts have no shingles; they are alike, and like
    nothing else.  Texts of fewer words than a shingle are one shingle.  Only doc_id and text are read, whatever else there is;
    doc_id may be null or repeated.  An empty table has no links.
    """
    own = docs.select(row.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    lanes = [f"l{i}" for i in range(LANES)]
    prints = cut(own.mapInArrow(_Sketches(), "row long, doc_id long, " + ", ".join(f"{x} long" for x in [*lanes, "words"])))
    distinct = cut(prints.groupBy(*lanes, "words").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")))
    at = distinct.select("first", *lanes).mapInArrow(_to_anchors_of_lanes, "anchor long, fp long, row long")
    found = at.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_AtAnchors(), "anchor long, a long, b long, bits int")
    found = cut(found.groupBy("anchor", "a", "b").agg(F.min("bits").alias("bits")))
    links = cut(prints.join(distinct.where("copies > 1"), [*lanes, "words"]).where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")))
    sketches = lambda end, x: distinct.select(F.col("first").alias(end), *(F.col(c).alias(f"{x}{c}") for c in lanes))
    apart = F.expr(" + ".join(f"bit_count(x{c} ^ y{c})" for c in lanes))
    pairs = found.where("anchor IS NULL").select("a", "b").join(sketches("a", "x"), "a").join(sketches("b", "y"), "b")
    pairs = cut(pairs.select("a", "b", apart.cast("int").alias("bits")).where(F.col("bits") <= SKETCH_BITS))
    crowds = found.where("anchor IS NOT NULL").select("anchor", F.col("a").alias("row"))
    needed = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).union(crowds.select("row")).distinct()
    sets = own.select("row", "text").join(needed, "row", "left_semi").mapInArrow(_Shingles(words), "row long, shingles array<long>")
    sets = bucketed(sets, "row", "shingles")
    links = _joining(pairs, sets, links, similarity)
    if not crowds.isEmpty() and (others := _crowded_pairs(crowds, sets, links, similarity)) is not None:
        links = _joining(cut(others), sets, links, similarity)
    return prints.select("row", "doc_id"), links


def similar_surplus(docs: DataFrame, row: Column, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row): all rows but one of each group of similar texts, that with the smallest doc_id (null ids last, then the smallest row)."""
    rows, links = similar_links(docs, row, words, similarity)
    members = components(links).join(rows, F.col("node") == F.col("row")).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("place"))
    first = members.groupBy("root").agg(F.min("place").alias("first"))
    return members.join(first, "root").where("place.row <> first.row").select("place.row")
