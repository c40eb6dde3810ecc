"""SentencePiece encoding and decoding of texts of any length, by a max-plus parallel scan.

The model is of the byte-pair kind.  A sequence of pieces is the encoding of a
text exactly if each two neighbours are the encoding of the text that they
make up, so encoding is a path through the lattice of pieces on which an edge
between neighbours that don't get on weighs minus infinity and a piece weighs its
score: the best path, by max-plus algebra.

A giant text is cut into chunks anywhere.  The state at a border is the piece that
reaches or crosses it and how far it goes beyond; a chunk gives the transfer matrix
from the states at its left border to those at its right one.  Matrices combine
associatively, blocks of them into one before the row vector of states is passed
along; each chunk is then traced back by itself between its two known states.

Between two characters that no piece has side by side (a word's end before a space,
above all) every path has a border of pieces and every pair of neighbours gets on.
A matrix is therefore computed in full only up to the first such place of a chunk
and from the last one; what lies between is the same for all states, word by word,
and words are remembered.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, tokenizer_path

#: Characters of a chunk, and chunks whose matrices are combined at first.
CHUNK = 1 << 15
COMBINED = 64
#: Words, and parts of words, that a worker remembers before it starts afresh.
MEMO = 600_000
SPACE = "▁"
#: A state: (piece, characters beyond the border).  The text's beginning has no piece.
State = tuple[str, int]
START: State = ("", 0)
Matrix = dict[State, dict[State, float]]


class Model:
    """Pieces, scores and ids of a byte-pair model file; which pieces get on as neighbours."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or spec.name != "identity" or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: another kind of model than this reads")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == p.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.text = [p.piece if p.type == p.NORMAL else "" for p in proto.pieces]
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id))
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        # Every end of a piece, with the piece's score if it is one: what isn't here ends no piece.
        self.ends: dict[str, float | None] = {p[i:]: None for p in self.id for i in range(len(p) - 1)}
        self.ends.update((p, x) for p, x in self.score.items() if len(p) > 1)
        # The order in which merges are made, and the two parts that each piece is merged from; characters have neither.
        self.order = {p: i for i, p in enumerate(sorted((p for p in self.id if len(p) > 1), key=lambda p: -self.score[p]))}
        self.parts: dict[str, tuple[str, str]] = {}
        for p in self.order:
            if SPACE * 2 not in p:
                self.parts[p] = self.last_merge(p)
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def ids(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.byte[b] for b in piece.encode()]

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def last_merge(self, piece: str) -> tuple[str, str]:
        """The two parts that the piece is merged from last, when it is encoded by itself."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return "", ""
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def gets_on(self, left: str, right: str) -> bool:
        if not left or left[-1] + right[0] not in self.pairs:
            return True
        key = (left, right)
        found = self.neighbours.get(key)
        if found is None:
            if len(self.neighbours) > 2 * MEMO:
                self.neighbours.clear()
            found = self.neighbours[key] = self.fits(left, right)
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether no merge crosses from ``left`` into ``right`` before both are whole.

        Both are taken apart from their facing ends, the later made first; what would merge across at that time, before
        the part was merged into the next, tells.  Runs of spaces have merges of one score, so these are merged outright.
        """
        if SPACE * 2 in left or SPACE * 2 in right or left[-1] == right[0] == SPACE:
            return self.merge(left + right) == [left, right]
        order, parts = self.order, self.parts
        limit = 1 << 40  # merges from here on come too late
        while True:
            made = order.get(left + right)
            if made is not None and made < limit:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def ending(self, text: str, end: int) -> list[str]:
        """Pieces of ``text`` that end at ``end``, the longest first; a character that is no piece is one all the same."""
        found, n = [text[end - 1]], 2
        while n <= end and (piece := text[end - n : end]) in self.ends:
            if self.ends[piece] is not None:
                found.append(piece)
            n += 1
        return found[::-1]

    def reach(self, text: str, state: State, end: int) -> dict[int, tuple[str, float]]:
        """By place up to ``end``: the last piece and the weight of the best path there from ``state`` at place 0.

        Of the edges into a place at most one has a weight above minus infinity, as a text has one encoding; the others
        aren't looked at once it is found.
        """
        at: dict[int, tuple[str, float]] = {state[1]: (state[0], 0.0)}
        score, ends, neighbours, gets_on = self.score, self.ends, self.neighbours, self.gets_on
        start = state[1]
        for e in range(start + 1, end + 1):
            found = [text[e - 1]]
            for b in range(e - 2, start - 1, -1):
                piece = text[b:e]
                if piece not in ends:
                    break
                if b in at and ends[piece] is not None:
                    found.append(piece)
            while found:
                piece = found.pop()  # the longest first
                before = at.get(e - len(piece))
                if before is None:
                    continue
                fits = neighbours.get((before[0], piece))
                if fits is None:
                    fits = gets_on(before[0], piece)
                if fits:
                    at[e] = (piece, before[1] + score.get(piece, -1e6))
                    break
        return at

    @staticmethod
    def back(at: dict[int, tuple[str, float]], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            piece = at[end][0]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def safe(self, text: str, place: int) -> bool:
        return text[place - 1 : place + 1] not in self.pairs

    def word(self, word: str) -> bytes:
        """Ids of a stretch between two safe places; it is cut at the safe places within."""
        found = self.words.get(word)
        if found is None:
            pairs = self.pairs
            cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
            if cuts:
                found = b"".join([self.words.get(part) or self.path(part) for part in map(word.__getitem__, map(slice, [0, *cuts], [*cuts, len(word)]))])
            else:
                found = self.path(word)
        return found

    def path(self, part: str) -> bytes:
        """Ids along the best path through a stretch."""
        found = array("I", [i for piece in self.back(self.reach(part, START, len(part)), 0, len(part)) for i in self.ids(piece)]).tobytes()
        if len(part) <= 64:
            if len(self.words) > MEMO:
                self.words.clear()
            self.words[part] = found
        return found

    def middle(self, text: str) -> bytes:
        """Ids of what lies between two safe places: words with the spaces before them."""
        head, *words = text.split(SPACE)
        first = [self.word(head)] if head else []
        if "" in words:  # a run of spaces belongs to the word that follows
            out, run = first, 1
            for i, word in enumerate(words):
                if word or i == len(words) - 1:
                    out.append(self.word(SPACE * run + word))
                    run = 1
                else:
                    run += 1
            return b"".join(out)
        found = list(map(self.spaced.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    ids = found[i] = self.word(SPACE + words[i])
                    if len(words[i]) <= 64:
                        if len(self.spaced) > MEMO:
                            self.spaced.clear()
                        self.spaced[words[i]] = ids
        return b"".join(first + found)

    def first_safe(self, text: str, least: int, end: int) -> int:
        return next((i for i in range(max(1, least), end) if self.safe(text, i)), -1)

    def last_safe(self, text: str, least: int, end: int) -> int:
        return next((i for i in range(end - 1, least - 1, -1) if self.safe(text, i)), -1)


@lru_cache(maxsize=1)
def model_at(path: str) -> Model:
    """One model a worker process, so that what it remembers serves all of its tasks."""
    return Model(path)


def left_states(model: Model, before: str, text: str) -> list[State]:
    """The states possible at the border of ``before`` and ``text``, as far as the text at hand tells."""
    if not before:
        return [START]
    both, border = before + text, len(before)
    return [(piece, beyond) for beyond in range(min(model.longest, len(text) + 1)) for piece in model.ending(both, border + beyond) if len(piece) > beyond]


def transfer(model: Model, before: str, chunk: str, after: str) -> Matrix:
    """From each state at the chunk's left border to those at its right border, with the weight of the best path.

    ``before`` and ``after`` are what lies around the chunk, as long as the longest piece; nothing at the text's ends.
    """
    n, text = len(chunk), chunk + after[: model.longest]
    reaches = [n] if not after else range(n, min(len(text), n + model.longest - 1) + 1)

    def right(at: dict[int, tuple[str, float]], offset: int) -> dict[State, float]:
        return {(at[e - offset][0], e - n): at[e - offset][1] for e in reaches if e - offset in at and len(at[e - offset][0]) > e - n}

    states = left_states(model, before, text)
    furthest = max(beyond for _, beyond in states)
    a = model.first_safe(text, furthest + 1, n)
    b = model.last_safe(text, a, n) if a > 0 else -1
    if a < 0:  # every state has its own path through all of the chunk
        return {s: right(model.reach(text, s, max(reaches)), 0) for s in states if s[1] <= max(reaches)}
    tail = right(model.reach(text[b:], START, max(reaches) - b), b)
    # What lies between the two safe places weighs the same for all states: nothing, then.
    heads = {s: model.reach(text, s, a).get(a) for s in states}
    return {s: {t: h[1] + w for t, w in tail.items()} for s, h in heads.items() if h}


def combine(left: Matrix, right: Matrix) -> Matrix:
    """The max-plus product."""
    out: Matrix = {}
    for s, row in left.items():
        best: dict[State, float] = {}
        for m, w in row.items():
            for t, v in right.get(m, {}).items():
                if t not in best or w + v > best[t]:
                    best[t] = w + v
        if best:
            out[s] = best
    return out


def borders(matrices: list[Matrix]) -> list[State]:
    """The state at every border of the best path: products of blocks first, then the vector, then within the blocks."""
    groups = [matrices[i : i + COMBINED] for i in range(0, len(matrices), COMBINED)]
    products = []
    for group in groups if len(groups) > 1 else []:
        while len(group) > 1:  # any order of combination gives the same
            group = [combine(*group[i : i + 2]) if len(group[i : i + 2]) == 2 else group[i] for i in range(0, len(group), 2)]
        products.append(group[0])
    outer = _walk(products, START, None) if products else [START, None]
    states: list[State] = [START]
    for group, first, last in zip(groups, outer, outer[1:]):
        states += _walk(group, first, last)[1:]
    return states


def _walk(matrices: list[Matrix], first: State, last: State | None) -> list[State]:
    vectors: list[dict[State, tuple[float, State | None]]] = [{first: (0.0, None)}]
    for matrix in matrices:
        vector: dict[State, tuple[float, State | None]] = {}
        for s, (w, _) in vectors[-1].items():
            for t, v in matrix.get(s, {}).items():
                if t not in vector or w + v > vector[t][0]:
                    vector[t] = (w + v, s)
        vectors.append(vector)
    state = last if last is not None else max((s for s in vectors[-1] if s[1] == 0), key=lambda s: vectors[-1][s][0])
    path = [state]
    for vector in reversed(vectors[1:]):
        path.append(vector[path[-1]][1])
    return path[::-1]


def trace(model: Model, chunk: str, after: str, left: State, right: State) -> bytes:
    """Ids of the pieces that begin in the chunk, between the states at its borders."""
    n, text = len(chunk), chunk + after[: model.longest]
    end = n + right[1]
    ids = lambda pieces: array("I", [i for p in pieces for i in model.ids(p)]).tobytes()
    a = model.first_safe(text, left[1] + 1, n) if left[1] < n else -1
    if a < 0:
        return ids(model.back(model.reach(text, left, end), left[1], end))
    b = model.last_safe(text, a, n)
    head = model.back(model.reach(text, left, a), left[1], a)
    tail = model.back(model.reach(text[b:], START, end - b), 0, end - b)
    return ids(head) + (model.middle(text[a:b]) if b > a else b"") + ids(tail)


def encode(model: Model, text: str, chunk: int = CHUNK) -> bytes:
    """Ids of one text, in this process; the cluster does the same with its chunks apart."""
    if not text:
        return b""
    text = model.prefix + text.replace(" ", SPACE)
    parts = [(text[max(0, i - model.longest) : i], text[i : i + chunk], text[i + chunk : i + chunk + model.longest]) for i in range(0, len(text), chunk)]
    states = borders([transfer(model, *p) for p in parts])
    return b"".join(trace(model, p[1], p[2], *s) for p, s in zip(parts, zip(states, states[1:])))


def decode(model: Model, ids: list[int] | memoryview) -> str:
    """The text that ids stand for; bytes that are no UTF-8 give U+FFFD each."""
    out: list[str] = []
    held = bytearray()

    def flush() -> None:
        while held:
            try:
                out.append(held.decode())
                held.clear()
            except UnicodeDecodeError as e:
                out.append(held[: e.start].decode() + "�")
                del held[: e.start + 1]

    for i in ids:
        byte = model.of_byte.get(i)
        if byte is not None:
            held.append(byte)
        else:
            flush()
            out.append(model.text[i])
    flush()
    return "".join(out).replace(SPACE, " ")


_CHUNKS = "row long, doc_id long, chunk int, chunks int, before string, body string, after string"


class _Cut:
    """Chunks of the texts, with what lies around them."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(self.path)
        k = model.longest
        for batch in blocks(batches, "text", 4 << 20):
            rows = []
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = model.prefix + text.replace(" ", SPACE)
                starts = range(0, len(text), self.size)
                rows += [(row, doc_id, j, len(starts), text[max(0, i - k) : i], text[i : i + self.size], text[i + self.size : i + self.size + k]) for j, i in enumerate(starts)]
            yield _batch(rows, _CHUNKS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], list(names))


class _Transfer:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(self.path)
        for batch in batches:
            row, chunk, before, body, after = (batch.column(n).to_pylist() for n in ("row", "chunk", "before", "body", "after"))
            yield _batch([(r, c, zlib.compress(pickle.dumps(transfer(model, x, y, z)))) for r, c, x, y, z in zip(row, chunk, before, body, after)], "row long, chunk int, matrix binary")


def _matrices(table: pa.Table) -> list[Matrix]:
    return [pickle.loads(zlib.decompress(m)) for m in table.column("matrix").to_pylist()]


def _product(table: pa.Table) -> pa.Table:
    """The product of a block of ``COMBINED`` neighbouring chunks of one text."""
    group = _matrices(table.sort_by("chunk"))
    while len(group) > 1:  # any order of combination gives the same
        group = [combine(*group[i : i + 2]) if len(group[i : i + 2]) == 2 else group[i] for i in range(0, len(group), 2)]
    first = [table.column(n)[0].as_py() for n in ("row", "block")]
    return pa.Table.from_batches([_batch([(*first, zlib.compress(pickle.dumps(group[0])))], "row long, block int, matrix binary")])


def _states(keys: list[tuple], states: list[State], ddl: str) -> pa.Table:
    return pa.Table.from_batches([_batch([(*k, *x, *y) for k, x, y in zip(keys, states, states[1:])], ddl)])


def _scan(table: pa.Table) -> pa.Table:
    """One text's products, in order of its blocks -> the states at each block's borders."""
    table = table.sort_by("block")
    return _states(list(zip(table.column("row").to_pylist(), table.column("block").to_pylist())), _walk(_matrices(table), START, None), _OUTER)


def _within(table: pa.Table, outer: pa.Table) -> pa.Table:
    """One block's matrices and the states at its borders -> the states at each chunk's borders."""
    table = table.sort_by("chunk")
    first, last = ((outer.column(f"{x}_piece")[0].as_py(), outer.column(f"{x}_beyond")[0].as_py()) for x in ("left", "right"))
    return _states(list(zip(table.column("row").to_pylist(), table.column("chunk").to_pylist())), _walk(_matrices(table), first, last), _STATES)


_OUTER = "row long, block int, left_piece string, left_beyond int, right_piece string, right_beyond int"
_STATES = "row long, chunk int, left_piece string, left_beyond int, right_piece string, right_beyond int"


def _ids_batch(names: list[str], columns: list, ids: list[bytes], checks: list[bool]) -> pa.RecordBatch:
    joined = b"".join(ids)
    offsets = pa.array([0, *_running([len(x) // 4 for x in ids])], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), len(joined) // 4, [None, pa.py_buffer(joined)]))
    return pa.RecordBatch.from_arrays([*columns, lists, pa.array(checks, pa.bool_())], [*names, "ids", "decoded"])


def _running(sizes: list[int]) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


class _Trace:
    """Ids of each chunk, and whether they decode to what the pieces that begin in it cover."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(self.path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, checks = [], []
            for body, after, lp, lb, rp, rb in zip(*(batch.column(n).to_pylist() for n in ("body", "after", "left_piece", "left_beyond", "right_piece", "right_beyond"))):
                found = trace(model, body, after, (lp, lb), (rp, rb))
                ids.append(found)
                checks.append(decode(model, memoryview(found).cast("I")) == (body + after)[lb : len(body) + rb].replace(SPACE, " "))
            yield _ids_batch(["doc_id", "chunk", "chunks"], [batch.column(n) for n in ("doc_id", "chunk", "chunks")], ids, checks)


class _Whole:
    """Texts of one chunk: both borders are the text's own ends."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(self.path)
        for batch in blocks(batches, "text", 1 << 20):
            texts = [model.prefix + t.replace(" ", SPACE) if t else "" for t in batch.column(1).to_pylist()]
            ids = [model.middle(t) if t else b"" for t in texts]
            checks = [decode(model, memoryview(i).cast("I")) == t.replace(SPACE, " ") for i, t in zip(ids, texts)]
            n = batch.num_rows
            yield _ids_batch(["doc_id", "chunk", "chunks"], [batch.column(0), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32())], ids, checks)


def piece_ids(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunk, chunks, ids, decoded: a row per chunk of each text; a text's ids are its chunks' ids in order.

    Ids are those that the library gives for the whole text, without begin and end.  ``decoded``: the ids give the
    chunk's text back (U+2581 as a space).  Null and empty texts are one chunk without ids.  Rows that repeat and null
    ids are encoded each for itself; an empty table gives an empty one.  Only doc_id and text are read.

    Only chunks of giant texts are shuffled.  Their matrices, some KB for each 32 KB of text, are combined in blocks of
    ``COMBINED``, the products in one task a text (one for each 2 MB of it), then every block is walked and every chunk
    traced by itself.  ``docs`` must be read alike each time, as a written table is.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") >= chunk
    whole = own.where(~giant).select("doc_id", "text").mapInArrow(_Whole(path), "doc_id long, chunk int, chunks int, ids array<int>, decoded boolean")
    chunks = own.where(giant).mapInArrow(_Cut(path, chunk), _CHUNKS).repartition("row", "chunk")
    matrices = chunks.select("row", "chunk", "before", "body", "after").mapInArrow(_Transfer(path), "row long, chunk int, matrix binary")
    matrices = cut(matrices.withColumn("block", F.expr(f"chunk div {COMBINED}").cast("int")))
    outer = matrices.groupBy("row", "block").applyInArrow(_product, "row long, block int, matrix binary").groupBy("row").applyInArrow(_scan, _OUTER)
    states = matrices.groupBy("row", "block").cogroup(outer.groupBy("row", "block")).applyInArrow(lambda a, b: _within(a, b), _STATES)
    traced = chunks.join(states, ["row", "chunk"]).mapInArrow(_Trace(path), "doc_id long, chunk int, chunks int, ids array<int>, decoded boolean")
    return whole.unionByName(traced)
