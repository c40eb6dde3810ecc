"""Best-fit packing of token sequences, gaps filled first by exact complements.

Documents become pieces of at most ``capacity`` tokens.  What is packed is the
histogram of piece lengths, at most ``capacity`` numbers whatever the size of the
corpus: from the longest length down, the gap that it leaves is looked up among
the sums of single, pair and triple lengths that are still available, and as many
whole combinations are used up at once as the counts allow.  Lengths whose gaps no
combination fills exactly are packed by best fit, decreasing.  The result is a
table of recipes (which lengths, how many sequences); a piece finds its place by
its rank among the pieces of its length, which counts per bucket give without
sorting any length in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, tokenizer_path

CAPACITY = 4096
END = 1

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters on whose class, case and normal form Python and the tokenizer can't differ; \x1c-\x1f are white space to Python alone.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff\u0152\u0153\u2010-\u2027\u20ac]*")
_LETTERS = "a-z\xdf-\xf6\xf8-\xff\u0153"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies, by the Latin-1 character of the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as the tokenizers file at ``path`` gives them, as little-endian unsigned 32-bit numbers.

    The file's pre-tokenizer cuts a lower-cased text into words that its model then takes one by one, and a worker
    remembers words.  Texts of plain characters are cut here by the same expression; any other text, and one that holds
    a special token, is left to the library between one white space and the next, across which it joins nothing either.
    """

    #: Words remembered, and their characters at most: one that is longer is forgotten with its batch.
    MEMO, LONGEST = 600_000, 64

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split, *rest = spec["pre_tokenizer"]["pretokenizers"]
        known = split["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        if not known or [r["type"] for r in rest] != ["ByteLevel"] or rest[0]["add_prefix_space"]:
            raise ValueError(f"{path}: another pre-tokenizer than this reads")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.words) > self.MEMO:
            self.words = {}
        tokenize, letters = self.model.tokenize, self.letters
        for word in words.difference(self.words):
            shown = word.encode().decode("latin-1").translate(letters)
            self.words[word] = array("I", [t.id for t in tokenize(shown)]).tobytes()

    def library(self, text: str) -> bytes:
        out = []
        for word in re.split("[ \t\n\r]+", text):
            ids = self.others.get(word)
            if ids is None:
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
                if len(word) <= self.LONGEST:
                    if len(self.others) > self.MEMO // 10:
                        self.others = {}
                    self.others[word] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        plain = [_PLAIN.fullmatch(t or "") and not any(s in (t or "") for s in self.special) for t in texts]
        split = [_WORDS.findall(t.lower()) if t and p else [] for t, p in zip(texts, plain)]
        every = set().union(*split)
        self.learn(every)
        for text, p, words in zip(texts, plain, split):
            yield b"".join(map(self.words.__getitem__, words)) if p else self.library(text)
        for word in every:
            if len(word) > self.LONGEST:
                del self.words[word]


class _Pieces:
    def __init__(self, path: str, capacity: int):
        self.path, self.capacity = path, capacity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = Encoder(self.path), 4 * self.capacity
        for batch in blocks(batches, "text", 4 << 20):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and the end id, in pieces of ``capacity``."""
    path = path or tokenizer_path("word_bpe_49k.json")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_Pieces(path, capacity), _PIECES)


Recipe = tuple[tuple[tuple[int, int], ...], int]


class _Available:
    """Counts by length, and which are above zero as the bits of two integers, one of them mirrored.

    Pairs of lengths that add up to a sum are then the bits that both have, the mirrored one shifted by the sum.
    """

    def __init__(self, capacity: int, n: np.ndarray):
        self.capacity, self.n = capacity, n
        self.bits = sum(1 << int(x) for x in np.flatnonzero(n))
        self.mirrored = sum(1 << capacity - int(x) for x in np.flatnonzero(n))

    def take(self, length: int, times: int) -> None:
        before, self.n[length] = self.n[length] > 0, self.n[length] - times
        if before != (self.n[length] > 0):
            self.bits ^= 1 << length
            self.mirrored ^= 1 << self.capacity - length

    def pairs(self, total: int, least: int = 1) -> int:
        """Bit x: x and total - x are both available, least <= x <= total - x."""
        both = self.bits & self.mirrored >> self.capacity - total
        return (both & (1 << total // 2 + 1) - 1) >> least << least

    def complement(self, gap: int) -> list[int] | None:
        """Lengths, one to three of them, that are available often enough and add up to ``gap``."""
        n = self.n
        if n[gap] > 0:
            return [gap]
        if x := self.best(self.pairs(gap), gap, 0):
            return [gap - x, x]
        for c in range(1, gap // 3 + 1):
            if n[c] > 0 and (found := self.pairs(gap - c, c)) and (x := self.best(found, gap - c, c)):
                return [gap - c - x, x, c]
        return None

    def best(self, found: int, total: int, third: int) -> int:
        """Of the pairs the one of which there are most, so that few steps use many up; 0 if copies are too few."""
        best, most = 0, 0
        while found:
            x = (found & -found).bit_length() - 1
            found &= found - 1
            use = Counter([x, total - x, *[third] * (third > 0)])
            if (times := min(self.n[v] // k for v, k in use.items())) > most:
                best, most = x, times
        return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Recipe]:
    """Recipes (lengths with how often each, number of sequences) that use every piece up."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        n[length] = count
    recipes: list[Recipe] = []
    if n[capacity]:
        recipes.append((((capacity, 1),), int(n[capacity])))
        n[capacity] = 0
    available = _Available(capacity, n)
    for length in range(capacity - 1, 0, -1):
        while n[length]:
            available.take(length, 1)  # itself, while its complement is looked up
            combination = available.complement(capacity - length)
            available.take(length, -1)
            if combination is None:
                break
            use = Counter([length, *combination])
            times = int(min(n[x] // k for x, k in use.items()))
            for x, k in use.items():
                available.take(x, k * times)
            recipes.append((tuple(sorted(use.items(), reverse=True)), times))
    # What no combination fills exactly: best fit, decreasing, alike pieces and alike sequences at once.
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    fits = np.zeros(capacity + 1, bool)
    for length in range(capacity - 1, 0, -1):
        left = int(n[length])
        while left:
            gaps = np.flatnonzero(fits[length:])
            if len(gaps):
                gap = length + int(gaps[0])
                kept, many = room[gap].pop()
                times = min(left, many)
                if times < many:
                    room[gap].append((kept, many - times))
                fits[gap] = bool(room[gap])
                added = (*kept, length)
                rest = gap - length
            else:
                each = capacity // length
                times, added = (left // each, (length,) * each) if left >= each else (1, (length,) * left)
                rest = capacity - length * len(added)
                left -= times * (len(added) - 1)
            left -= times
            if rest:
                room[rest].append((added, times))
                fits[rest] = True
            else:
                recipes.append((tuple(sorted(Counter(added).items(), reverse=True)), times))
    recipes.extend((tuple(sorted(Counter(kept).items(), reverse=True)), many) for group in room.values() for kept, many in group)
    return recipes


def places(recipes: list[Recipe]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, each, first sequence, offset in the sequence) of every recipe's part."""
    rank: Counter = Counter()
    sequence, out = 0, []
    for lengths, times in recipes:
        offset = 0
        for length, each in lengths:
            out.append((length, rank[length], rank[length] + each * times, each, sequence, offset))
            rank[length] += each * times
            offset += length * each
        sequence += times
    return out


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, bucket_rows: int = 1 << 18) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of ``docs``.

    Null and empty texts are one piece of the end id alone.  Rows that repeat are packed each for itself; null ids too.
    An empty table gives an empty one.  Only doc_id and text are read.

    The pieces (without their ids) are materialised once; the driver gets the histogram, at most ``capacity`` rows.
    A recipe uses up at least one length, so the table of places is bounded by a few times ``capacity`` and is broadcast.
    """
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, path, capacity))
    counts = cut_pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}
    total = sum(histogram.values())
    buckets = max(1, -(-total // bucket_rows))
    mixed = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    ranked = cut_pieces.withColumn("bucket", mixed)
    # Rank among the pieces of a length: what lies in the buckets before, then the rank in its own.
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("in_bucket", F.row_number().over(own) - 1)
    if buckets > 1:
        sizes = ranked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("k"))
        before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("length", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
        ranked = ranked.join(offsets, ["length", "bucket"])
    else:
        ranked = ranked.withColumn("before", F.lit(0).cast("long"))
    table = spark.createDataFrame(places(plan(histogram, capacity)), "part_length long, rank_from long, rank_to long, each long, first_sequence long, part_offset long")
    rank = F.col("before") + F.col("in_bucket")
    at = rank - F.col("rank_from")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("part_length")) & (rank >= F.col("rank_from")) & (rank < F.col("rank_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.expr("(before + in_bucket - rank_from) div each")).alias("sequence_id"), (F.col("part_offset") + (at % F.col("each")) * F.col("length")).alias("offset"))
