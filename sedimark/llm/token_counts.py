"""Token counts without tokens: Arrow batches in, lengths out.

A cut between two characters is *safe* when no piece of the vocabulary holds that
pair of characters side by side: no merge can cross it, so both sides are encoded
alike alone and together.  In this vocabulary a space after any other character is
safe, so a text is a row of short stretches, each of which is encoded once per
worker and remembered; stretches without a space are cut at other safe places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced, tokenizer_path

SPACE = "▁"
#: Characters of a stretch without a space that are encoded in one call.
STRETCH = 1 << 16
#: Words that a worker remembers before it starts afresh, and their characters at most; longer ones are counted where they stand.
MEMO, LONGEST = 500_000, 64


class PieceCounter:
    """Counts the pieces of texts as the sentencepiece model at ``path`` gives them by default."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        plain = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        user = any(p.type == p.USER_DEFINED for p in model.pieces)
        self.pairs = {p.piece[i : i + 2] for p in model.pieces if p.type == p.NORMAL for i in range(len(p.piece) - 1)}
        if not plain or user or any(p[1] == SPACE != p[0] for p in self.pairs):
            raise ValueError(f"{path}: spaces are no safe boundary in this model")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        # The same model without the prefix, for stretches from within a text.
        spec.add_dummy_prefix = False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.words: dict[str, int] = {}

    def stretch(self, text: str) -> int:
        if len(text) <= STRETCH:
            return len(self.processor.encode(text, num_threads=1))
        n, start = 0, 0
        while start < len(text):
            end = min(start + STRETCH, len(text))
            while end < len(text) and text[end - 1 : end + 1] in self.pairs:
                end += 1
            n += len(self.processor.encode(text[start:end], num_threads=1))
            start = end
        return n

    def learn(self, words: set[str]) -> None:
        """Counts of those words that aren't remembered yet, in one call of the library."""
        if len(self.words) > MEMO:
            self.words = {}
        new = list(words.difference(self.words))
        short = [w for w in new if len(w) < STRETCH]
        self.words.update(zip(short, map(len, self.processor.encode([SPACE + w for w in short], num_threads=1))))
        if len(short) < len(new):
            self.words.update((w, self.stretch(SPACE + w)) for w in new if len(w) >= STRETCH)

    def __call__(self, texts: list[str]) -> list[int]:
        split = [(self.prefix + t.replace(" ", SPACE)).split(SPACE) if t else [] for t in texts]
        words = set().union(*(words[1:] for words in split))
        self.learn(words)
        counts = [self.total(words) for words in split]
        for word in words:
            if len(word) > LONGEST:
                del self.words[word]
        return counts

    def total(self, words: list[str]) -> int:
        if not words:
            return 0
        n = self.stretch(words[0]) if words[0] else 0
        if "" not in words[1:]:
            return n + sum(map(self.words.__getitem__, words[1:]))
        # A run of spaces belongs to the word that follows.
        run, last = 0, len(words) - 1
        for i, word in enumerate(words):
            if i and (word or i == last):
                n += self.words[word] if not run else self.stretch(SPACE * (run + 1) + word)
                run = 0
            elif i:
                run += 1
        return n


class _Count:
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounter(self.path)
        for batch in balanced(batches, "text"):
            texts = batch.column(1)
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            tokens = pa.array(count(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, tokens, pa.compute.greater(tokens, self.limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, without begin, end or added special tokens.

    Null and empty texts have none of either.  Repeated rows and null ids are counted like any other; an empty table
    gives an empty one.  Only doc_id and text are read.  Narrow: no shuffle.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_Count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
