"""BPE, lexical search and periodic runs against the library, plain versions and odd rows."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logloom.llm import bpe, lexical, registry, runs
from logloom.llm.common import table

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
CLASH = ["block", "n", "ids", "runs", "w", "h", "g", "a", "p", "one", "item", "term", "score", "rank", "best", "start", "length", "period"]

ROWS = [
    (1, "one two three four five six seven"),
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "word " * 40_000 + "end"),
    (6, "é😀 漢字 über ½ " * 50),
    (None, "no id at all, and and and and and and and and and and and and and"),
    (7, "x" * 30_000),
    (8, "<|endoftext|>it's  <|endoftext|><|endoftext|> x<|endoftext"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def content():
    return Path(BPE).read_text(encoding="utf-8")


@pytest.fixture(scope="module")
def vocabulary(content):
    return bpe.Vocabulary(content)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def random_texts(n):
    draw = random.Random(7)
    parts = ["aaaa", "the", "ing", "tion", "<|endoftext|>", " ", "  ", "\n", "ss", "abab", "'ll", "'s", "1234", "…", "ß", "é", " "]

    def one():
        kind, size = draw.random(), draw.randint(0, 50)
        if kind < 0.3:
            return "".join(draw.choice("ab \n\t'sdtrelvm.,019<|>") for _ in range(size))
        if kind < 0.5:
            return "".join(chr(draw.choice([draw.randint(1, 0x2FF), draw.randint(1, 0xD7FF), draw.randint(0xE000, 0x10FFFF)])) for _ in range(size))
        if kind < 0.7:
            return "".join(draw.choice(parts) for _ in range(size))
        return "".join(draw.choice("aeiourstnlh") for _ in range(size))

    return [one() for _ in range(n)]


def test_ids_equal_those_of_the_library(library, content):
    encoder, texts = bpe.Encoder(content, bpe._odd_characters(content)), random_texts(4_000)
    assert [ids_of(x) for x in encoder(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_characters_that_unicode_versions_class_differently(library, content):
    odd = re.compile(bpe._odd_characters(content))
    points = [chr(p) for p in range(0x80, 0x110000, 7) if not 0xD800 <= p < 0xE000]
    texts = [f"a{c}a1{c}1.{c}. {c}" for c in points if odd.match(c)][:300] + [f"a{c}a1{c}1.{c}. {c}" for c in points[::40]]
    encoder = bpe.Encoder(content, odd.pattern)
    assert [ids_of(x) for x in encoder(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_compatible_pairs_are_those_that_merging_leaves_apart(vocabulary):
    draw = np.random.default_rng(3)
    sound = np.flatnonzero(vocabulary.sound)
    x, y = draw.choice(sound, 20_000), draw.choice(sound[:2_000], 20_000)
    fits = vocabulary.compatible(x, y).tolist()
    want = [vocabulary.merged(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b] for a, b in zip(x.tolist(), y.tolist())]
    assert fits == want and 0.2 < np.mean(fits) < 0.99


def test_only_failing_words_are_merged(vocabulary, monkeypatch):
    seen, real = [], bpe.Vocabulary.merged
    monkeypatch.setattr(bpe.Vocabulary, "merged", lambda self, w: seen.append(w) or real(self, w))
    words = [b" the", b" tokenization", b" therouou", b"aaaaaaaaaaa"]
    found, failing = vocabulary.encode_words(words)
    assert found == [real(vocabulary, w) for w in words]
    assert failing == len(seen) < len(words)
    assert all(vocabulary.proposed(w) != real(vocabulary, w) for w in words if w in seen)


def test_long_words_merge_like_short_ones(vocabulary, monkeypatch):
    words = [w.encode() for w in random_texts(300)]
    want = [vocabulary.merged(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [vocabulary.merged(w) for w in words] == want


def test_a_vocabulary_out_of_order_is_never_trusted(content):
    given = json.loads(content)
    merges = given["model"]["merges"]
    merges[:] = merges[::-1]
    turned = bpe.Vocabulary(json.dumps(given))
    assert not turned.sound.any()
    words = [b" the", b" other", b"aaaa"]
    assert turned.encode_words(words) == ([turned.merged(w) for w in words], 3)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}])
def test_unsupported_vocabularies_are_refused(content, change):
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(json.loads(content) | change))


def test_bpe_odd_rows(spark, docs, library):
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in bpe.encode(clashing(docs), BPE).collect())
    want = Counter((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in ROWS)
    assert got == want
    assert bpe.encode(docs.limit(0), BPE).collect() == []
    back = bpe.encode(docs, BPE).select("doc_id", bpe.decode(F.col("ids"), BPE).alias("text"), bpe.unpacked(F.col("ids")).alias("ids"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in ROWS)
    bad = spark.createDataFrame([(bytearray(struct.pack("<2I", 50256, 128)),), (None,)], "ids binary")
    assert [r[0] for r in bad.select(bpe.decode(F.col("ids"), BPE)).collect()] == [library.decode([50256, 128], skip_special_tokens=False), ""]


@needs_data
def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = registry.QUERIES["op11_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# Lexical search


def plain_search(docs, items):
    terms = lambda t: re.findall(lexical.TERM, (t or "").translate({ord(a): b for a, b in zip(lexical.UPPER, lexical.LOWER)}))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in counted if c]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[: lexical.BEST])]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_a_plain_one(spark):
    # Small blocks and bundles, so that bounds, ties and passes all take part.
    draw = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Rare", "É", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 40)))) for i in range(700)]
    docs += [(1_000 + i, "w50 w51 rare") for i in range(150)] + [(None, "rare É"), (3, "w50 w51 rare"), (3, "w50 w51 rare")]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(20)] + [(None, "w50 rare"), (20, ""), (21, None), (4, "É"), (22, "none of it")]
    a, b = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    assert found(lexical.search(a, b)) == want
    assert found(lexical.search(clashing(a), clashing(b), block=64, bundle=7, pass_terms=100)) == want


def test_owners_share_the_work_by_weight():
    df = np.array([1, 1, 2, 50, 100, 400])
    plan = lexical.Plan(np.zeros(6, int), np.arange(6), 1, 6, 500, 9_000, df, np.ones(6, int))
    assert plan.owner.tolist() == sorted(plan.owner.tolist()) and len(set(plan.owner.tolist())) > 1
    assert plan.rest[-1].tolist() == [0] and (np.diff(plan.rest[:, 0]) <= 0).all()


def test_search_odd_rows(spark, docs):
    items = spark.createDataFrame([("a", "one AND end"), (None, "über"), ("b", None)], "item_id string, text string")
    assert found(lexical.search(clashing(docs), items)) == plain_search(ROWS, [("a", "one AND end"), (None, "über"), ("b", None)])
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id IN (2, 3, 4)"), items).collect() == []
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r["doc_id"] for r in lexical.search(named, items).collect()} == {"d1", "d5", "d6", None}


# Periodic runs


def plain_runs(words, least=runs.LEAST):
    best: dict = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            first = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > first and i - first + q >= max(least, 2 * q):
                best.setdefault((first, i - first + q), q)
            i += 1
    rows = sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in rows for i in range(s + q, s + n)}
    return rows, [w for i, w in enumerate(words) if i not in dropped]


def repetitive(draw):
    letters, size = draw.choice([1, 2, 2, 3, 5, 30]), draw.choice([0, 1, 11, 12, 13, 30, 100, 250])
    words = [draw.choice("abcdefghijklmnopqrstuvwxyzABCD"[:letters]) for _ in range(size)]
    if size > 3 and draw.random() < 0.6:
        a, p = draw.randrange(size), draw.randint(1, size // 2)
        words = [words[(a + (i - a) % p) % size] if i >= a else w for i, w in enumerate(words)]
        if draw.random() < 0.5:
            words[draw.randrange(size)] = "z"
    if draw.random() < 0.1:  # Fibonacci words are full of runs
        x, y = "a", "b"
        for _ in range(10):
            x, y = x + y, x
        words = list(x)
    return words * draw.choice([1, 1, 1, 2])


def test_runs_equal_plain_ones():
    draw = random.Random(5)
    for _ in range(80):
        docs = [repetitive(draw) for _ in range(draw.randint(1, 10))]
        for words, (n, rows, kept) in zip(docs, runs.find([" ".join(w).encode() for w in docs])):
            want, left = plain_runs(words)
            assert (n, rows, kept.decode().split()) == (len(words), want, left)


def test_the_number_of_seeds_is_bounded():
    # Thousands of occurrences of one gram: each word gets a bounded number of seeds for each class of periods.
    for words in (["a"] * 20_000, ["a", "b"] * 10_000, (["a"] * 99 + ["b"]) * 200):
        grams, n = runs.Grams(np.unique(words, return_inverse=True)[1]), len(words)
        low, overlap, high = 1, 6, 11
        while low <= n // 2:
            power = max(0, (overlap * 2 // 3).bit_length() - 1)
            i, _ = runs._seeds(grams[power], overlap - (1 << power) + 1, low, high)
            assert len(i) <= 5 * n
            low, high, overlap = high + 1, 2 * high + 1, high + 1
    assert runs.find([b"a " * 300_000])[0][1] == [(0, 300_000, 1)]


def test_run_lengths_at_the_limits():
    distinct = [f"d{i}" for i in range(50)]
    for words, want in (
        (["a"] * 11, []),
        (["a"] * 12, [(0, 12, 1)]),
        ((["a", "b"] * 6)[:11], []),
        (distinct[:6] * 2, [(0, 12, 6)]),
        (distinct[:7] * 2, [(0, 14, 7)]),
        ((distinct[:7] * 2)[:13], []),
        (distinct + distinct, [(0, 100, 50)]),
        (distinct + distinct[:49], []),
    ):
        assert runs.find([" ".join(words).encode()])[0][1] == want == plain_runs(words)[0]


def test_runs_odd_rows(docs):
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.periodic_runs(clashing(docs)).collect())
    want = Counter()
    for i, text in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        rows, left = plain_runs(words) if len(words) < 1_000 else ([(0, 40_000, 1)], ["word", "end"])
        want[(i, len(words), tuple(rows), " ".join(left))] += 1
    assert got == want
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def check_digests(rows, texts):
    for r in rows:
        found, left = plain_runs(planted(r["doc_id"], texts[r["doc_id"]]))
        longest = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *longest)
        assert r["exponent_milli"] == (1000 * longest[1] // longest[2] if found else None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(left).encode()).hexdigest()


@needs_data
def test_runs_query(spark):
    # Plain comparison takes the square of a text's words: the longest are compared by the next test's shorter ones.
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = registry.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    check_digests([r for r in rows if len((texts[r["doc_id"]] or "").split()) < 2_000], texts)


def test_planted_runs(spark):
    draw = random.Random(2)
    texts = {i: draw.choice([" ", "\n", "  "]).join(repetitive(draw)) for i in range(300)} | {300: None, 301: "", 302: " \t"}
    given = clashing(spark.createDataFrame([*texts.items()], DOCS))
    check_digests(runs.run_digests(runs.with_planted_runs(given)).collect(), texts)
    hashes = [zlib.crc32(str(i).encode()) % 10 for i in texts]
    assert hashes.count(0) > 10
