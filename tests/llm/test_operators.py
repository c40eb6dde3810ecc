"""Operators on small tables against brute force, the libraries and exact round trips; odd inputs for all of them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from sedimark.llm import ann, exact_dedup, langid, packing, piece_scan, pii, quotes, simhash, token_counts, toxicity
from sedimark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, lang="en"):
    parts = {"en": ["the", "th", "ing", "and", "er", "on", "wh"], "de": ["sch", "ein", "ung", "der", "ü", "ich"], "fr": ["eau", "ê", "que", "oi", "le", "é"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, repeats, ties, other scripts."""
    long = words(random.Random(9), 20_000)
    return [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t", "en", None, 4), (4, long, "en", "a", 1), (5, long, "en", "b", 1), (5, long, "en", "b", 1),
        (6, "x" * 70_000, "en", "a", 1), (7, "12345 !!! ...", "de", "a", 1), (8, "漢字 😀 é<s></s><|endoftext|>", "fr", "a", 1), (9, "Hello World", "en", "a", 1), (10, "hELLO wORLD", "en", "a", 1), (None, "Hello World", "en", "a", 1), (11, "É", "fr", "a", 1), (12, "é", "fr", "a", 1),
        (13, "a▁b  ▁ c ", "en", "a", 1), (14, "one two", "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = odd_rows()
    for i in range(100, 400):
        lang = rng.choice(["en", "de", "fr"])
        text = words(rng, rng.randint(5, 120), lang)
        rows.append((i, text, lang, "a", len(text)))
        if rng.random() < 0.2:
            rows.append((i + 1000, text.upper() if rng.random() < 0.5 else text + " tail", lang, "hot", len(text)))
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def crowded(docs):
    """The same rows with columns whose names the operators use themselves."""
    return docs.select("*", *(F.lit(1).alias(c) for c in ("row", "fp", "kept", "keep_id", "t", "_row", "ids", "severity", "cluster", "lang_pred", "held_out", "length", "bucket", "root")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return (text or "").encode().lower()


def test_exact_dedup(docs, crowded, empty):
    rows = docs.collect()
    classes = defaultdict(list)
    for r in rows:
        classes[lowered(r.text)].append(r.doc_id)
    for found in (exact_dedup.exact_dedup(docs).collect(), exact_dedup.exact_dedup(crowded, limit=1).collect()):
        assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in rows)
        by_sha = defaultdict(list)
        for r in found:
            by_sha[r.text_sha256].append(r)
        assert len(by_sha) == len(classes)
        for text, ids in classes.items():
            group = by_sha[hashlib.sha256(text).hexdigest()]
            best = max((i for i in ids if i is not None), default=None)
            assert {r.keep_id for r in group} == {best} and {r.group_size for r in group} == {len(ids)}
            assert [r.doc_id for r in group if r.kept] == [best]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_one_head(spark):
    """Texts of one length and one head, copies among them in many blocks: split by further bytes on the cluster."""
    rng = random.Random(21)
    head = "the same head for all of them, word for word, and longer than a key " * 9
    rows = [(i, head + f"{rng.randrange(250):04d}" + "x" * 4000 + f"{rng.randrange(3):04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    classes = defaultdict(list)
    for i, t in rows:
        classes[t].append(i)
    for limit in (1, 200_000, exact_dedup.GROUP_BYTES):
        found = {r.doc_id: r for r in exact_dedup.exact_dedup(df, limit=limit).collect()}
        assert len(found) == 900
        for ids in classes.values():
            assert {(found[i].keep_id, found[i].group_size, found[i].kept) for i in ids} == {(max(ids), len(ids), k) for k in {i == max(ids) for i in ids}}


def test_radix_classes():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 100, 700]))) for _ in range(300)]
    groups = exact_dedup.radix_classes(texts + texts)
    assert sorted(i for g in groups for i in g) == list(range(600))
    assert all(len({(texts + texts)[i] for i in g}) == 1 for g in groups) and len(groups) == len(set(texts))


def test_token_counts(docs, crowded, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = token_counts.token_counts(crowded).collect()
    wanted = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == wanted
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found) and token_counts.token_counts(empty).count() == 0


def test_token_counts_fuzz():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, count, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path), random.Random(2)
    texts = ["".join(rng.choice(" ▁▁  abthein<s>/\n\t0é漢😀\0") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert count(texts) == [len(x) for x in library.encode(texts)]


def test_long_words_are_not_remembered():
    """Texts without spaces: counts and ids stay right, and nothing longer than the limit is held."""
    from tokenizers import Tokenizer

    import sentencepiece

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(8)
    texts = [" ".join("".join(rng.choice("abtheinon漢字") for _ in range(n)) for n in (3000, 5, 64, 65)) for _ in range(20)]
    library, count = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path)
    assert count(texts) == [len(x) for x in library.encode(texts)] and max(map(len, count.words)) <= token_counts.LONGEST
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encode = Tokenizer.from_file(path), packing.Encoder(path)
    assert [list(memoryview(b).cast("I")) for b in encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, [*encode.words, *encode.others])) <= encode.LONGEST


def test_piece_scan():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_scan.Model(path), random.Random(4)
    ids = lambda b: list(memoryview(b).cast("I")) if b else []
    for _ in range(1500):
        text = "".join(rng.choice(" ▁  abtheinonre<s>/\n0é漢😀") for _ in range(rng.randint(0, 80)))
        for chunk in (1, 3, 17, 1000):
            found = ids(piece_scan.encode(model, text, chunk))
            assert found == library.encode(text)
        assert piece_scan.decode(model, found)[1:] == text.replace("▁", " ") or not text
    without = "thein" * 3000
    assert ids(piece_scan.encode(model, without, 1000)) == library.encode(without)


def test_matrices_are_associative():
    model = piece_scan.Model(public_tokenizers.path("piece_bpe_32k.model"))
    text = "▁" + "thereinafter" * 30
    parts = [(text[max(0, i - 16) : i], text[i : i + 20], text[i + 20 : i + 36]) for i in range(0, len(text), 20)]
    m = [piece_scan.transfer(model, *p) for p in parts]
    assert piece_scan.combine(piece_scan.combine(m[0], m[1]), m[2]) == piece_scan.combine(m[0], piece_scan.combine(m[1], m[2]))


def test_piece_ids(docs, crowded, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = defaultdict(list)
    for r in piece_scan.piece_ids(crowded, chunk=1000).orderBy("chunk").collect():
        assert r.decoded
        found[r.doc_id].append((r.chunk, r.chunks, r.ids))
    for r in docs.where("doc_id IS NOT NULL AND doc_id <> 5").collect():
        assert sum((x[2] for x in found[r.doc_id]), []) == library.encode(r.text or "")
        assert [x[0] for x in found[r.doc_id]] == list(range(found[r.doc_id][0][1]))
    assert len(found[4]) > 10 and piece_scan.piece_ids(empty).count() == 0


def brute_fingerprint(text, width=3):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, crowded, empty):
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    wanted = Counter((r.doc_id, f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(crowded).collect()) == wanted
    assert simhash.near_duplicates(empty).count() == 0


def test_anchor_links(spark):
    """Planted fingerprints at up to three bits, a dense cluster among them, against all pairs."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(300)]
    for x in base[:150]:
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        base.append(x)
    core = rng.getrandbits(64)
    base += [core ^ (1 << a) ^ (1 << b) for a in range(32, 62) for b in range(a)][:700]
    prints = sorted(set(base))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    got = components(simhash.fingerprint_links(df)).collect()
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    groups = defaultdict(set)
    for i, k in enumerate(label):
        groups[k].add(int(x[i].view(np.int64)))
    found = defaultdict(set)
    for r in got:
        found[r.root].add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    a, b = simhash.spanning_links(x[: 10])
    assert len(a) == len(b)


def shingle_set(text, width=5):
    w = lowered(text).split()
    return {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({b" ".join(w)} if w else set())


def test_similar_links(spark, crowded):
    """Every link is right by brute force; planted near copies are found; nothing else goes."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        own = words(rng, 300).split()
        rows.append((2 * i, " ".join(own)))
        for _ in range(6):
            own[rng.randrange(len(own))] = "edited"
        rows.append((2 * i + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    links = {(r.a, r.b) for r in simhash.similar_links(df, F.col("doc_id"))[1].collect()}
    assert all(alike(a, b) for a, b in links)
    wanted = {(2 * i, 2 * i + 1) for i in range(150) if alike(2 * i, 2 * i + 1)}
    assert len(wanted) > 100 and len(links & wanted) >= 0.97 * len(wanted)
    assert {r.row for r in simhash.similar_surplus(df, F.col("doc_id")).collect()} == {b for _, b in links}
    odd = simhash.similar_surplus(crowded, F.monotonically_increasing_id())
    assert odd.select("row").distinct().count() == odd.count() < crowded.count()
    assert simhash.similar_surplus(df.limit(0), F.col("doc_id")).count() == 0


def test_similar_star(spark):
    """Copies that are similar to their original alone end in its group, wherever it stands among them."""
    rng = random.Random(31)
    original = words(rng, 300).split()
    rows = []
    for i in range(301):
        own = list(original)
        for j in range(5 if i != 150 else 0):
            own[rng.randrange(60 * j + 5, 60 * j + 55)] = f"e{i}x{j}"
        rows.append((i, " ".join(own)))
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(alike(150, i) for i in sets) and not any(alike(0, i) for i in sets if i not in (0, 150))
    links = {(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"))[1].collect()}
    assert all(alike(a, b) for a, b in links)
    assert len({a + b - 150 for a, b in links}) >= 0.9 * 300


def groups_of(pairs, nodes):
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for i in nodes:
        out[find(i)].add(i)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


@pytest.mark.parametrize("boilerplate", ["the same phrase " * 300, " ".join(f"line{i} of the notice" for i in range(40))])
def test_similar_families_in_one_crowd(spark, boilerplate):
    """Families of near copies behind one long common head: their fingerprints crowd the same anchors; all groups are found."""
    rng = random.Random(5)
    rows = []
    for family in range(30):
        own = words(rng, 60 if "line0" in boilerplate else 150).split()
        for k in range(3):
            edited = list(own)
            edited[7 * k] = f"x{family}x{k}"
            rows.append((3 * family + k, boilerplate + " " + " ".join(edited)))
    sets = {i: shingle_set(t) for i, t in rows}
    wanted = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(wanted) >= 60
    links = [(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"))[1].collect()]
    assert set(links) <= {(min(p), max(p)) for p in wanted} and groups_of(links, sets) == groups_of(wanted, sets)


def test_similar_crowd_in_slices(spark, monkeypatch):
    """A crowd of more rows than a worker compares at once: chains, stars and strangers of one template, by brute force."""
    rng = random.Random(6)
    head, rows = words(rng, 150).split(), []
    for i in range(240):
        own = list(head)
        for j in range(rng.choice([1, 3, 6])):
            own[rng.randrange(len(own))] = f"slot{i % 40}x{j}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(simhash, "SLICE", 50)
    monkeypatch.setattr(simhash, "HUB", 5)
    sets = {i: shingle_set(t) for i, t in rows}
    wanted = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = [(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"))[1].collect()]
    assert groups_of(links, sets) == groups_of(wanted, sets)


def test_crowded_pairs_are_complete(spark):
    """The prefix filter loses no pair at the threshold."""
    rng = random.Random(14)
    pool = list(range(1000, 1200))
    own = {i: sorted(rng.sample(pool, rng.choice([8, 20, 21, 25]))) for i in range(40)}
    for i in range(40, 120):
        like = set(own[rng.randrange(40)])
        for _ in range(rng.randint(0, 3)):
            like.discard(rng.choice(sorted(like)))
            like.add(rng.choice(pool))
        own[i] = sorted(like)
    sets = spark.createDataFrame(list(own.items()), "row long, shingles array<long>")
    crowds = spark.createDataFrame([(7, i) for i in own], "anchor long, row long")
    none = spark.createDataFrame([], "a long, b long")
    found = {(r.a, r.b) for r in simhash._crowded_pairs(crowds, sets, none, 0.8).collect()}
    wanted = {(a, b) for b in own for a in range(b) if 10 * len(set(own[a]) & set(own[b])) >= 8 * len(set(own[a]) | set(own[b]))}
    assert len(wanted) > 50 and wanted <= found and len(found) < 120 * 119 / 4


def test_similar_recall_on_documents(spark):
    """All pairs of the sf0.01 documents by brute force over shared rare shingles; groups must be the same but for one in ten."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {}
    for r in docs.collect():
        texts.setdefault(lowered(r.text), r.doc_id)
    sets = {i: shingle_set(t.decode()) for t, i in texts.items()}
    holders = defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    seen = {(a, b) for l in holders.values() for a in l for b in l if a < b}
    wanted = [(a, b) for a, b in seen if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = [(r.a, r.b) for r in simhash.similar_links(docs.where(F.col("doc_id").isin(list(sets))), F.col("doc_id"))[1].collect()]
    assert set(links) <= set(wanted)
    of = {i: k for k, g in enumerate(groups_of(links, sets)) for i in g}
    assert sum(a in of and of.get(a) == of.get(b) for a, b in wanted) >= 0.9 * len(wanted)


def test_packing(docs, crowded, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = packing.best_fit_packing(crowded, bucket_rows=50).collect()
    wanted = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in found)
    assert len(sequences) <= -(-total // 4096) + 1 and packing.best_fit_packing(empty).count() == 0


def test_plan_is_complete_and_tight():
    rng = random.Random(5)
    for histogram in ({rng.randint(1, 4096): rng.randint(1, 50) for _ in range(300)}, {2500: 1000, 3: 5}, {1: 10_000}, {4096: 7}, {}):
        recipes = packing.plan(dict(histogram))
        used = Counter()
        for lengths, times in recipes:
            assert sum(x * k for x, k in lengths) <= 4096
            used.update({x: k * times for x, k in lengths})
        assert used == Counter(histogram) and len(packing.places(recipes)) < 30_000


def test_encoder_fuzz():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(6)
    library, encode = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["".join(rng.choice(" \t\n\x1c\x85\xa0　'stremdlab<|endoftext|>09²½ΣςİiAÉé漢😀\0%!ﬁǅ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert [list(memoryview(b).cast("I")) if b else [] for b in encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_language_id(docs, crowded, empty):
    found = {}
    for r in langid.language_id(crowded).collect():
        found.setdefault(r.doc_id, r)
    for r in docs.where("doc_id IS NOT NULL").collect():
        f = found[r.doc_id]
        letters = any(c.isalpha() for c in r.text or "")
        assert f.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= f.score <= 1
        assert (f.lang_pred == "und") == (not letters)
    clean = [r for r in docs.where("doc_id BETWEEN 100 AND 399").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in clean) >= 0.95 * len(clean)
    assert langid.language_id(empty).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_profile_distance_by_hand():
    """Out-of-place distance of blocks against a plain implementation."""
    def grams(text):
        padded = "".join(c.lower() if c.isalpha() else " " for c in text)
        out = Counter()
        for w in padded.split():
            w = "_" + w + "_"
            out.update(w[1:-1]), out.update(w[i : i + 2] for i in range(len(w) - 1)), out.update(w[i : i + 3] for i in range(len(w) - 2))
        return out

    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    texts = ["Hello, the world's ends", "eau, que! ÉTÉ", "a", "", "x1y", None]
    doc, gram, count = langid.ngrams(texts, langid._Alphabet())
    got = defaultdict(Counter)
    for d, g, c in zip(doc.tolist(), gram.tolist(), count.tolist()):
        got[d][g] += c
    assert {d: dict(c) for d, c in got.items()} == {d: {key(g): n for g, n in grams(t or "").items()} for d, t in enumerate(texts) if grams(t or "")}
    ranked = {"a": [key(g) for g, _ in grams(texts[0]).most_common()], "b": [key(g) for g, _ in grams(texts[1]).most_common()]}
    best, score, far = langid.Classifier(ranked)(texts, langid._Alphabet())
    assert best[:2] == ["a", "b"] and best[3] == best[5] == "und" and score[3] == 0


def test_distances_scores_and_ties_by_brute_force():
    """Out-of-place distance, score and the choice among equals, in plain Python from the definition."""
    def profile(text):
        padded = "".join(c.lower() if c.isalpha() else " " for c in text)
        out = Counter()
        for w in padded.split():
            w = "_" + w + "_"
            out.update(w[1:-1]), out.update(w[i : i + 2] for i in range(len(w) - 1)), out.update(w[i : i + 3] for i in range(len(w) - 2))
        key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return [g for _, g in sorted((-n, key(g)) for g, n in out.items())]

    rng = random.Random(23)
    ranked = {lang: profile(words(rng, 400, lang))[:size] for lang, size in (("de", 300), ("en", 260), ("fr", 300))}
    ranked["zz"] = ranked["en"]  # a tie: the name that is first wins
    texts = [words(rng, rng.randint(1, 40), rng.choice(["en", "de", "fr"])) for _ in range(200)] + ["q", "漢字", "--"]
    size = max(map(len, ranked.values()))
    best, score, far = langid.Classifier(ranked, 50)(texts, langid._Alphabet())
    for t, b, s, f in zip(texts, best, score, far):
        own = profile(t)[:50]
        if not own:
            assert (b, s, f) == ("und", 0, 1)
            continue
        distance = {lang: sum(min(abs(r.index(g) - i), size) if g in r else size for i, g in enumerate(own)) / (len(own) * size) for lang, r in ranked.items()}
        order = sorted(distance.values())
        assert b == min(distance, key=lambda x: (distance[x], x)) and abs(f - order[0]) < 1e-12 and abs(s - (order[1] - order[0]) / max(order[1], 1e-12)) < 1e-9


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(d))]
            return 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, r in BASE.items() for m in re.finditer(r, text or "") if good(k, m[0]))


def test_personal_data(spark, docs, crowded, empty):
    rng = random.Random(7)
    parts = ["a", "b.", "@", "1", "22", "255", "256", ".", " ", "-", "+1", "(2) ", "555", "4111111111111111", "4111 1111 1111 1111", "é", "😀", "\n", "000"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for i in range(1500)] + [(5000, "1" * 20_000), (5001, "a@" * 2000), (5002, "1.1.1.1 " * 2000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (texts, crowded):
        own = {r.doc_id: r.text for r in df.collect()}
        for r in pii.digests(pii.personal_data(df)).where("doc_id IS NOT NULL").collect():
            wanted = brute_spans(own[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
            assert r.spans == wanted or r.spans.startswith(wanted) and "context:" in r.spans
            assert r.n_email == wanted.count("email:") and r.n_card == wanted.count("card:")
    assert pii.personal_data(empty).count() == 0


def test_bootstrap_finds_unseen_identifiers(spark):
    """A context that always holds addresses gives away one that the base expression misses; others are left alone."""
    rows = [(i, f"please contact user{i}@mail.example.org today") for i in range(20)] + [(50, "please contact user50@localhost today"), (51, "meet me at gate42b tomorrow"), (52, "again user50@localhost here")]
    found = {r.doc_id: r for r in pii.digests(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[50].spans == "context:15:31" and found[52].n_context == 1 and found[51].spans == "" and found[3].spans == "email:15:37"
    masked = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[3] == "please contact [EMAIL] today" and masked[50] == "please contact [CONTEXT] today" and masked[51] == rows[21][1]


def test_redaction_leaves_no_character_of_any_span(spark):
    """Overlapping spans of all kinds: the text that is left is what lies outside all of them, in order."""
    rng = random.Random(17)
    parts = ["1.2.3.4", "@", "5.6.7.8", " ", "a", "+1 555 010 9999", "4111 1111 1111 1111", "-", ".", "é😀", "user", "host.org"]
    rows = [(0, "1.2.3.4@5.6.7.8"), (1, None), (2, "")] + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(3, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(99)).withColumn("_row", F.lit(99)).withColumn("start", F.lit("s")).repartition(3).cache()
    spans = {r.doc_id: r.spans for r in pii.digests(pii.personal_data(df)).collect()}
    found = {r.doc_id: r for r in pii.redact(df).collect()}
    assert found[0].text == "[EMAIL]" and found[1].text is None and found[2].text == ""
    for i, text in rows:
        hidden = set()
        for span in filter(None, spans[i].split(",")):
            _, start, end = span.split(":")
            hidden.update(range(int(start), int(end)))
        assert "".join(re.split(r"\[(?:EMAIL|IP|CARD|PHONE|CONTEXT)\]", found[i].text or "")) == "".join(c for j, c in enumerate(text or "") if j not in hidden)
        assert (found[i].row, found[i]["_row"], found[i].start) == (99, 99, "s")


def test_bootstrap_by_either_side(spark):
    """The word before or the word after tells alone where the other varies; a card that failed its test stays out."""
    rng = random.Random(3)
    rows = [(i, f"{words(rng, 3)} mailto: user{i}@mail.example.org {words(rng, 2)}") for i in range(12)] + [(20, "kind words mailto: admin@localhost zebra")]
    rows += [(30 + i, f"{words(rng, 2)} | 4111 1111 1111 1111 | {words(rng, 2)}") for i in range(8)] + [(50, "x | 4111111111111112 | y"), (51, "see page12345 mailto us")]
    found = {r.doc_id: r.spans for r in pii.digests(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[20] == "context:19:34" and found[50] == "" and found[51] == ""


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(12, size=3000)] + 0.4 * rng.standard_normal((3000, 24))).astype(np.float32)
    x[100:140] = x[99]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [float("nan")] * 24, 0), (5060, [1.0, None] * 12, 0), (5080, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int")
    got = defaultdict(list)
    for r in ann.nearest(df, block=500).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    wide, hits = x.astype(np.float64), 0
    for q, found in got.items():
        score = (wide * wide[q]).sum(axis=1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(3000), -score))[:20]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True) and len(found) == 20
        assert all(abs(score[v] - s) < 1e-9 for v, s in found)
        hits += len({v for v, _ in found} & set(order.tolist()))
    assert hits >= 0.98 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r["rank"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(0)).count() == 0


def vectors_table(spark, path, x):
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))}), path)
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("shape", ["isotropic", "weak clusters", "clusters"])
def test_nearest_where_clusters_are_skipped(spark, tmp_path, shape):
    """50,000 vectors, with and without clear clusters, against brute force: recall holds where not all clusters are searched."""
    rng, n = np.random.default_rng(77), 50_000
    x = rng.standard_normal((n, 64))
    if shape == "weak clusters":
        x += rng.standard_normal((12, 64))[rng.integers(0, 12, n)]
    elif shape == "clusters":
        x = rng.standard_normal((300, 64))[rng.integers(0, 300, n)] + 0.3 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got: dict[int, set] = {}
    for r in ann.nearest(vectors_table(spark, tmp_path / "v.parquet", x), every=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, x = 0, x.astype(np.float64)
    for i in range(0, n, 200):
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-score)[:20].tolist()))
    print(shape, hits / (20 * n / 200))
    assert hits >= 0.93 * 20 * n / 200


def test_nearest_exactly(spark, tmp_path):
    """The exact way, ties and all: the same rows in the same order as brute force."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (1500, 8)).astype(np.float32)
    x[~x.any(axis=1)] = 1
    x[700:760] = x[699]
    got = defaultdict(list)
    for r in ann.nearest(vectors_table(spark, tmp_path / "v.parquet", x), exact=True, block=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = x.astype(np.float64)
    for q in range(0, 1500, 20):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -score)).tolist() if i != q][:20]
        assert got[q] == [(i, score[i]) for i in order]


def test_nearest_of_other_dimensions_and_repeated_ids(spark):
    """Vectors are compared with those of their own dimension; only a query's own row is no candidate."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.standard_normal(6)]) for i in range(1, 300)] + [(20 * i, [float(v) for v in rng.standard_normal(3)]) for i in range(50, 60)] + [(20, [9.0] * 6), (20, [8.0] * 6)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(1000, 1200, 20):
        mine = dict(rows)[q]
        wanted = sorted(((i, float(np.dot(mine, v))) for i, v in rows if len(v) == 3 and i != q), key=lambda p: (-p[1], p[0]))[:5]
        assert [i for i, _ in got[q]] == [i for i, _ in wanted] and np.allclose([s for _, s in got[q]], [s for _, s in wanted])
    assert len(got[20]) == 15 and sum(i == 20 and s == 6 * 72.0 for i, s in got[20]) == 2


def test_error_bound_covers():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((3, 64))
    c, p = np.zeros((1, 64)), ann.projection(64)
    assert p.shape == (64, 256) and np.allclose(p @ p.T, np.eye(64))
    offsets = pa.array(np.arange(0, x.size + 1, 64, dtype=np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["row", "vec_id", "v"])
    index = pa.Table.from_batches(list(ann._Encode(c, p)([batch])))
    value, bound = ann._Search(20, c, p).limits(index)(q)
    apart = np.abs(value - q @ x.T)
    assert len(index["code"][0].as_py()) == 32 and (apart <= bound).mean() > 0.98 and np.abs((value - q @ x.T).mean()) < 0.1


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there, how do I sort a list?"), (1, 1, "assistant", "> Hello there, how do I sort a list?\nUse sorted(x)."),
        (1, 2, "user", "On Monday the assistant wrote:\n>> Hello there, how do I sort a list?\n> Use sorted(x).\n\nThanks, and reversed?"),
        (1, 3, "assistant", "> hello THERE, how do I sort a list\nBack to the first."), (2, 0, "user", "> Thanks, and reversed?\nelsewhere"), (2, 5, None, None), (None, None, "user", "x"), (3, 0, "user", ""), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(1)).withColumn("level", F.lit(1))
    found = {(r.conv_id, r.turn, r.position): r for r in quotes.link_quotations(df).collect()}
    assert len(found) == len(rows)
    reply = lambda *k: (found[k].reply_conv, found[k].reply_turn, found[k].linked_by)
    assert reply(1, 1, 1) == (1, 0, "quote") and reply(1, 2, 2) == (1, 1, "quote") and reply(1, 3, 3) == (1, 0, "quote") and reply(2, 0, 0) == (1, 2, "quote") and reply(2, 5, 1) == (2, 0, "previous")
    assert found[1, 2, 2].text == "Thanks, and reversed?" and found[1, 2, 2].deepest == 2 and found[1, 2, 2].quotes == 2
    assert (found[1, 3, 3].thread_conv, found[2, 5, 1].thread_conv, found[2, 5, 1].depth) == (1, 1, 4)
    assert quotes.link_quotations(df.limit(0)).count() == 0
    long = spark.createDataFrame([(7, i, "user", f"turn {i}") for i in range(3000)], "conv_id long, turn long, role string, text string").repartition(4)
    assert all(r.position == r.turn and r.reply_turn == (r.turn - 1 if r.turn else None) for r in quotes.link_quotations(long).collect())


def test_trimmed_short_and_homeless_quotations(spark):
    """Parts of messages, wrapped anew, short ones, and those of a conversation without an id."""
    first = "Here is the first paragraph of it. It goes on for a while, as they do.\n\nSecond paragraph, line one\nand its second line\nand a third one.\n\nok so"
    rows = [
        (1, 0, "user", first), (1, 1, "user", "something else in between"), (1, 2, "user", "> and its second line\n> and a third one.\nabout these two"),
        (1, 3, "user", "> It goes on for a\n> while, as they do.\nwrapped"), (1, 4, "user", "yes i do"), (1, 5, "user", "no"), (1, 6, "user", "> yes i do\nshort"), (2, 0, "user", "> yes i do\nshort, elsewhere"),
        (None, 0, "user", "a message without any conversation"), (None, 1, "user", "another of them"), (None, 2, "user", "> a message without any conversation\nhello"), (None, None, "user", "first of all"), (3, 0, "user", "> another of them\nfrom outside"), (3, 1, "user", "a late reply"),
    ]
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    reply = lambda *k: (found[k].reply_conv, found[k].reply_turn, found[k].linked_by)
    assert reply(1, 2) == (1, 0, "quote") and reply(1, 3) == (1, 0, "quote") and reply(1, 6) == (1, 4, "quote") and reply(2, 0) == (None, None, "none")
    assert reply(None, 2) == (None, 0, "quote") and reply(3, 0) == (None, 1, "quote") and reply(3, 1) == (3, 0, "previous")
    assert found[3, 1].thread_conv is None and found[3, 1].depth == 4 and [found[k].place for k in ((None, None), (None, 0), (None, 1), (None, 2), (3, 0), (3, 1))] == list(range(6))


def test_threads_by_brute_force(spark, monkeypatch):
    """Random quotations within and between conversations: every reply, root, depth and order by a plain walk."""
    monkeypatch.setattr(quotes, "BLOCK_TURNS", 4)
    rng, rows, said = random.Random(41), [], {}
    for conv in range(12):
        for turn in range(rng.randint(1, 25)):
            own, quoted = words(rng, 9) + f" {conv} {turn}", None
            if rng.random() < 0.35 and said:
                quoted = rng.choice(sorted(said))
            text = own if quoted is None else "\n".join("> " + line for line in [said[quoted]]) + "\n\n" + own
            rows.append((conv, turn, "user", text))
            said[conv, turn] = own
    up = {}
    of = {v: k for k, v in said.items()}
    for conv, turn, _, text in rows:
        up[conv, turn] = of[text.split("\n")[0][2:]] if text.startswith("> ") else (conv, turn - 1) if turn else None
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    threads = defaultdict(list)
    for k, r in found.items():
        steps, at = 0, k
        while up[at] is not None:
            steps, at = steps + 1, up[at]
        assert (r.reply_conv, r.reply_turn) == (up[k] or (None, None)) and (r.thread_conv, r.depth) == (at[0], steps)
        threads[at[0]].append((r.place, k))
    for members in threads.values():
        order = [k for _, k in sorted(members)]
        assert order == sorted(order) and [p for p, _ in sorted(members)] == list(range(len(members)))


def test_toxicity(spark, docs, crowded, empty):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.3
        n = rng.choice([1, 4, 12]) if bad else 0
        rows.append((i, words(rng, 60) + " vile" * n + " " + rng.choice(["scumling", "scumwise"]) * (n > 1)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (4, 7), (99_999, 1)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(own, marks, rows=600).collect()}
    wanted = dict(labels[:1200])
    assert sum(found[i].toxic == bool(t) for i, t in wanted.items()) >= 0.97 * 1200
    dense = [found[i].severity for i, t in rows if t.count("vile") == 12]
    light = [found[i].severity for i, t in rows if t.count("vile") == 1]
    assert np.mean(dense) > np.mean(light) + 0.5 and all(0 <= r.severity <= 3 for r in found.values())
    odd = toxicity.toxicity(crowded, marks.limit(0)).collect()
    assert len(odd) == docs.count() and not any(r.toxic for r in odd)
    assert toxicity.toxicity(empty, marks).count() == 0


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.random(n) * 4
    grade = np.clip((x + 0.2 * rng.standard_normal(n)).astype(int), 0, 3)
    w, theta = toxicity.fit(np.arange(n), np.zeros(n, np.int64), x, grade, 1)
    assert w[0] > 0 and (np.diff(theta) > 0).all() and np.allclose(theta / w[0], [1, 2, 3], atol=0.15)


def test_likelihood_by_brute_force():
    """Fitted on a tiny table, no weight or threshold can be moved for a better likelihood, which is computed from its definition."""
    rng, n, width = np.random.default_rng(13), 60, 3
    x = rng.integers(0, 3, (n, width)).astype(float)
    grade = np.clip(np.round(x @ [0.9, -0.4, 0.0] + rng.normal(0, 0.8, n)), 0, 3).astype(int)
    row, column = np.nonzero(x)
    w, theta = toxicity.fit(row, column, x[row, column], grade, width, steps=4000, penalty=1e-3, rate=0.02)

    def loss(w, theta):
        total = 0.0
        for i in range(n):
            below = [0.0, *(1 / (1 + np.exp(-(t - x[i] @ w))) for t in theta), 1.0]
            total -= np.log(below[grade[i] + 1] - below[grade[i]])
        return total / n + 0.5e-3 * (w @ w)

    least = loss(w, theta)
    for i in range(width + 3):
        for step in (-0.01, 0.01):
            moved, shifted = w.copy(), theta.copy()
            if i < width:
                moved[i] += step
            else:
                shifted[i - width] += step
            assert loss(moved, shifted) > least - 1e-9
    model = toxicity.Model({"=a": w[0], "=b": w[1]}, theta.tolist())
    score = w[0] * np.log1p(2) + w[1] * np.log1p(1)
    assert np.allclose(model.exceed(["a b a", None]), [1 - 1 / (1 + np.exp(-(theta - score))), 1 - 1 / (1 + np.exp(-theta))])


def test_toxicity_on_labels_held_out(spark):
    """Real texts: fitted on two thirds of the labels, right on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    outside = labels.where("pmod(doc_id, 3) = 0 AND toxic IS NOT NULL")
    found = {r.doc_id: r.toxic for r in toxicity.toxicity(docs.join(outside, "doc_id", "left_semi").unionByName(docs.join(labels.where("pmod(doc_id, 3) <> 0"), "doc_id", "left_semi")), labels.where("pmod(doc_id, 3) <> 0")).collect()}
    truth = {r.doc_id: bool(r.toxic) for r in outside.collect() if r.doc_id in found}
    caught = [found[i] for i, t in truth.items() if t]
    clean = [not found[i] for i, t in truth.items() if not t]
    print(len(caught), np.mean(caught), len(clean), np.mean(clean))
    assert np.mean(caught) >= 0.8 and np.mean(clean) >= 0.97


def test_chat_quotations_against_sql(spark):
    import duckdb

    from sedimark.llm import queries

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = queries.chat_quotations(spark, sf)
    columns = sorted(df.columns)
    wanted = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['chat_quotations']})").fetchall()
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert Counter(found) == Counter(wanted) and sum(r[columns.index("linked_by")] == "quote" for r in found) > 50


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    steps, df = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        steps.append(df)
    language, exact, near, personal, packed = steps
    assert language.columns == exact.columns == near.columns == personal.columns == docs.columns
    assert language.where("text IS NULL OR NOT text RLIKE r'\\p{L}'").count() == 0
    texts = [lowered(r.text) for r in exact.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r.text) for r in language.collect()})
    assert near.count() <= exact.count() and personal.count() == near.count()
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in personal.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_stages_leave_other_columns_alone(spark, docs, tmp_path):
    """Columns with names that stages might use themselves pass as they are."""
    names = ("row", "_row", "fp", "kept", "keep_id", "_mask", "_all", "_lang_pred", "_score", "_distance", "lang_pred", "score", "start", "end", "kind", "first", "a", "b", "node", "root", "size")
    df = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert df.columns == [*docs.columns, *names] and all(r[n] == (None if r.doc_id is None else f"{n} {r.doc_id}") for r in df.collect() for n in names)


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
