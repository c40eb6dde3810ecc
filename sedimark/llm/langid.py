"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three
letters, words padded by a boundary mark) in order of frequency.  A document goes
to the language whose profile its own is nearest to: every n-gram of the document
costs as many points as its place differs from its place in the language's
profile, and the size of the profile where it isn't in it.

N-grams are numbers: three code points of 21 bits.  Counting is a sort of the
block's n-grams, so Python loops over documents or letters nowhere.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks

#: N-grams of a document's profile, and of a language's.
DOC_PROFILE = 300
LANG_PROFILE = 3000
#: Rows of a language that its profile is learned from, about; a bounded sample.
TRAIN_ROWS = 5000
#: Values of lang that are learned, the most frequent ones.
MAX_LANGUAGES = 512
MARK = ord("_")
UNKNOWN = "und"


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class _Alphabet:
    """Code points to letters, lower-cased; 0 for what is no letter.  Grows as code points are met."""

    def __init__(self):
        self.table = np.full(0x110000, 0xFFFFFFFF, np.uint32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        letters = self.table[points]
        if (new := letters == 0xFFFFFFFF).any():
            for p in np.unique(points[new]).tolist():
                low = chr(p).lower()
                self.table[p] = ord(low[0]) if unicodedata.category(chr(p))[0] == "L" else 0
            letters = self.table[points]
        return letters


def ngrams(texts: list[str | None], alphabet: _Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count), sorted by document and n-gram, of a block of texts."""
    parts, sizes = [], []
    for text in texts:
        points = _letters(text or "")
        parts += [points, np.array([32], "<u4")]
        sizes.append(len(points) + 1)
    points = np.concatenate([np.array([32], "<u4"), *parts])
    letters = alphabet(points)
    doc = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)]).astype(np.uint64)
    # Few distinct letters occur in a block: number them, so that document and n-gram fit one number to sort.
    seen = np.flatnonzero(np.bincount(letters))  # 0 is among them: the spaces between texts
    numbers = np.zeros(int(seen[-1]) + 1, np.uint64)
    numbers[seen] = np.arange(1, len(seen) + 1)  # boundary: 1
    code, is_letter = numbers[letters], letters != 0
    width = np.uint64(int(len(seen) + 1).bit_length())
    a, b, c = code[:-2], code[1:-1], code[2:]
    la, lb, lc = is_letter[:-2], is_letter[1:-1], is_letter[2:]
    keys = [
        (doc[1:-1] << np.uint64(3) * width | b)[lb],
        (doc[1:-1] << np.uint64(3) * width | a << width | b)[la | lb],
        (doc[1:-1] << np.uint64(3) * width | a << np.uint64(2) * width | b << width | c)[lb],
    ]
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    count = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    mask = (np.uint64(1) << width) - np.uint64(1)
    real = np.concatenate([[0, MARK], seen[1:]]).astype(np.uint64)
    gram = np.zeros(len(keys), np.uint64)
    for place in range(3):
        gram |= real[(keys >> np.uint64(place) * width & mask).astype(np.int64)] << np.uint64(21 * place)
    return (keys >> np.uint64(3) * width).astype(np.int64), gram, count


class _Count:
    """N-gram counts by language of a partition's labelled documents."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = _Alphabet()
        for batch in blocks(batches, "text", 4 << 20):
            langs = np.array(batch.column(0).to_pylist(), object)
            doc, gram, count = ngrams(batch.column(1).to_pylist(), alphabet)
            of = langs[doc] if len(doc) else np.empty(0, object)
            for lang in set(langs.tolist()):
                grams, at = np.unique(gram[of == lang], return_inverse=True)
                total = np.bincount(at, count[of == lang], len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(total)], ["lang", "gram", "n"])


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of each language, all of a language that has no more: those with the least hashes of doc_id."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    labelled = labelled.where(F.col("lang").isin(list(counts)))
    many = [F.when(F.col("lang") == lang, F.lit(int(rows / n * 2**32))) for lang, n in counts.items() if n > rows]
    if not many:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < F.coalesce(*many, F.lit(2**32)))


def profiles(labelled: DataFrame, size: int = LANG_PROFILE, rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language in a sample of ``labelled`` (doc_id, lang, text).

    Counts are summed on the cluster; the driver gets size rows per language and nothing that grows with the corpus.
    """
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counted = sample(usable, rows).select("lang", "text").mapInArrow(_Count(), "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("lang", "gram", "r").collect()
    out: dict[str, list[int]] = {}
    for row in sorted(top, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Classifier:
    """Nearest profile by out-of-place distance, for blocks of texts."""

    def __init__(self, ranked: dict[str, list[int]], doc_profile: int = DOC_PROFILE):
        self.langs, self.doc_profile = sorted(ranked), doc_profile
        self.size = max(map(len, ranked.values()), default=1)
        self.grams = np.unique(np.array([g for x in ranked.values() for g in x], np.int64).view(np.uint64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            grams = np.array(ranked[lang], np.int64).view(np.uint64)
            self.rank[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def __call__(self, texts: list[str | None], alphabet: _Alphabet) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1: how much nearer than the runner-up), and distance as a part of the largest possible."""
        best, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        doc, gram, count = ngrams(texts, alphabet)
        if not len(doc) or not self.langs:
            return best, score, far
        order = np.lexsort((gram, -count, doc))  # ties by code points
        doc, gram = doc[order], gram[order]
        start = np.searchsorted(doc, np.arange(len(texts)))
        place = np.arange(len(doc)) - start[doc]
        keep = place < self.doc_profile
        doc, gram, place = doc[keep], gram[keep], place[keep]
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        rank = self.rank[np.where(self.grams[at] == gram, at, len(self.grams))]
        out = np.where(rank < 0, self.size, np.minimum(np.abs(rank - place[:, None]), self.size))
        sums = np.zeros((len(texts), len(self.langs)))
        np.add.at(sums, doc, out) if len(self.langs) == 1 else [np.copyto(sums[:, k], np.bincount(doc, out[:, k], len(texts))) for k in range(len(self.langs))]
        n = np.bincount(doc, minlength=len(texts))
        has = n > 0
        part = sums / (np.maximum(n, 1)[:, None] * self.size)
        nearest = part.argmin(axis=1)
        ordered = np.sort(part, axis=1)
        second = ordered[:, 1] if len(self.langs) > 1 else np.ones(len(texts))
        score = np.where(has, np.clip((second - ordered[:, 0]) / np.maximum(second, 1e-12), 0, 1), 0.0)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(nearest.tolist(), has.tolist())], score, np.where(has, ordered[:, 0], 1.0)


class _Predict:
    """Adds lang_pred, score and distance to the columns, of which ``text`` stays only if it is kept."""

    def __init__(self, ranked: dict[str, list[int]], doc_profile: int, keep: bool, names: tuple[str, str, str] = ("lang_pred", "score", "distance")):
        self.ranked, self.doc_profile, self.keep, self.names = ranked, doc_profile, keep, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify, alphabet = Classifier(self.ranked, self.doc_profile), _Alphabet()
        for batch in blocks(batches, "text", 2 << 20):
            text = batch.schema.get_field_index("text")
            best, score, far = classify(batch.column(text).to_pylist(), alphabet)
            own = [i for i in range(batch.num_columns) if self.keep or i != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(best, pa.string()), pa.array(score), pa.array(far)], [*(batch.schema.names[i] for i in own), *self.names])


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2; not so where the id is null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame, doc_profile: int = DOC_PROFILE, lang_profile: int = LANG_PROFILE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance of every row of ``docs``.

    Profiles come from text and non-null lang of rows that aren't held out, about ``train_rows`` of each language; a prediction sees the text alone.
    Null texts, texts without a letter, and all texts where nothing could be learned are ``und`` with score 0.
    score: 1 - distance of the nearest / distance of the runner-up.  distance: out-of-place points as a part of the
    most possible, 1 for ``und``.  Ties go to the language that is first by name.  Rows that repeat stay; an empty table
    gives an empty one.  Only doc_id, text and lang are read.  Learned are the ``MAX_LANGUAGES`` most frequent values of
    lang, so that profiles (``lang_profile`` n-grams each), which go through the driver, stay within some 50 MB.
    """
    ranked = profiles(_labelled(docs), lang_profile, train_rows)
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return inputs.mapInArrow(_Predict(ranked, doc_profile, False), "doc_id long, held_out boolean, lang_pred string, score double, distance double")


def _labelled(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return own.where(~held_out(F.col("doc_id")))


def in_known_languages(docs: DataFrame, furthest: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with that as their ``lang``.

    Rejected are ``und`` texts (null, empty, without a letter) and those further than ``furthest`` of the largest possible
    distance from every profile; without a labelled row, all.  Rows that repeat stay, texts may be of any length, ties go to
    the language that is first by name, an empty table gives an empty one.  Other columns pass unchanged, whatever their names.
    """
    ranked = profiles(_labelled(docs))
    lang, score, distance = names = tuple(f"{x}_{uuid.uuid4().hex}" for x in ("lang", "score", "distance"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{lang} string, {score} double, {distance} double"])
    found = docs.mapInArrow(_Predict(ranked, DOC_PROFILE, True, names), schema).where((F.col(lang) != UNKNOWN) & (F.col(distance) <= furthest))
    return found.select(*(F.col(lang).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))
