"""Byte-level BPE by speculation and verification, and the way back.

A text is cut into words by the vocabulary's rule. For every new word the greedy longest match proposes
tokens. A row of tokens is what merging gives if and only if each is what merging makes of its own
bytes and every two neighbours are compatible: merging their joined bytes never joins across the border.
So all neighbours of all new words are tested at once, as arrays; words with an incompatible pair are
merged exactly, all others keep the proposal. A worker remembers the ids of words from task to task.

Whether two neighbours are compatible follows from the merges they were made by. Along the border stand,
from late to early, the left token, its right part, that one's right part and so on, against the right
token, its left part and so on. At any time one of each is there. A merge of the two would happen if it
comes before the merge that takes the left one into its own token (which has the earlier place in a tie)
and not after the one that takes the right one.

Null and empty texts have no ids. Special tokens in a text are found like the tokenizers library finds
them. Very long texts and words are encoded whole. Repeated and tied rows are encoded alike; an empty
table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, remembered, ship

CACHED_WORDS = 300_000  # words whose ids a Python worker remembers
LONGEST_CACHED = 64  # characters; longer words are encoded each time
SHORT = 100  # bytes; longer words are merged with a heap
NEVER = 1 << 40  # later than every merge

# The published rule by which byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shown_bytes() -> dict[str, int]:
    """The printable characters by which vocabulary files write bytes, by their usual rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = sorted({*range(256)} - {*plain})
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a tokenizers file, as arrays by token id."""

    def __init__(self, content: str):
        given = json.loads(content)
        model, byte_of = given["model"], shown_bytes()
        cut = given["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("only byte-level BPE without a prefix space is supported")
        if given["normalizer"] or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("normalisers, dropout, affixes and ignored merges are not supported")
        self.special = {}
        for token in given["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"the added token {token['content']!r} has an unsupported option")
            self.special[token["content"]] = token["id"]
        self.ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in [*self.ids.items(), *((c.encode(), i) for c, i in self.special.items())]:
            self.tokens[i] = token

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges]
        self.rank_of = {(a, b): rank for rank, (a, b, _) in reversed([*enumerate(pairs)])}
        self.result = [c for _, _, c in pairs]
        a, b, c = np.array(pairs, np.int64).reshape(-1, 3).T
        self.left, self.right, self.rank = (np.full(size, -1, np.int64) for _ in range(3))
        self.left[c], self.right[c], self.rank[c] = a, b, np.arange(len(c))
        keys = a * size + b
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.size = keys[self.order], size
        self.sound = self._sound(a, b, c)
        # Longest token by its first bytes, which bounds the longest match.
        self.reach: dict[bytes, int] = {}
        for token in self.ids:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 1))

    def _sound(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which tokens are what merging makes of their own bytes; all others are never trusted."""
        sound = np.array([len(t) == 1 for t in self.tokens])
        rank = np.arange(len(c))
        once = np.bincount(c, minlength=self.size)[c] == 1
        if not (once.all() and (self.rank[a] < rank).all() and (self.rank[b] < rank).all()):
            return np.zeros(self.size, bool)  # merges out of order: every word is merged exactly
        whole = self.compatible(a, b, rank)
        for x, y, z, fits in zip(a.tolist(), b.tolist(), c.tolist(), whole.tolist()):
            sound[z] = fits and sound[x] and sound[y]
        return sound

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge before ``before`` joins across the border of the tokens x and y, pair by pair."""
        fits, at = np.ones(len(x), bool), np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        taken_x, taken_y = (np.broadcast_to(np.asarray(before, np.int64), len(x)).copy() for _ in range(2))
        while len(at):
            joins = self.merge_rank(x, y)
            broken = (joins < taken_x) & (joins <= taken_y)
            fits[at[broken]] = False
            made_x, made_y = self.rank[x], self.rank[y]
            go_on = ~broken & ((made_x >= 0) | (made_y >= 0))
            at, x, y, taken_x, taken_y, made_x, made_y = (v[go_on] for v in (at, x, y, taken_x, taken_y, made_x, made_y))
            later = made_x > made_y
            taken_x, taken_y = np.where(later, made_x, taken_x), np.where(later, taken_y, made_y)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return fits

    def proposed(self, word: bytes) -> list[int] | None:
        """The greedy longest match; None if a byte has no token."""
        found, at, end, ids = [], 0, len(word), self.ids
        while at < end:
            for stop in range(min(end, at + self.reach.get(word[at : at + 2], 1)), at, -1):
                token = ids.get(word[at:stop])
                if token is not None:
                    break
            else:
                return None
            found.append(token)
            at = stop
        return found

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of least rank, the first of equal ones. Unknown bytes have no id."""
        tokens = [self.ids[word[i : i + 1]] for i in range(len(word)) if word[i : i + 1] in self.ids]
        if len(tokens) > SHORT:
            return self._merged_long(tokens)
        rank_of, result = self.rank_of, self.result
        ranks = [rank_of.get(pair, NEVER) for pair in zip(tokens, tokens[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            tokens[i : i + 2] = [result[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of.get((tokens[i - 1], tokens[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank_of.get((tokens[i], tokens[i + 1]), NEVER)
        return tokens

    def _merged_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap and links, in n log n."""
        rank_of, n = self.rank_of, len(tokens)
        after, ahead = [*range(1, n + 1)], [*range(-1, n - 1)]
        waiting = [(rank_of[pair], i, *pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if pair in rank_of]
        heapq.heapify(waiting)
        while waiting:
            rank, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = self.result[rank], -1
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for left, right in ((ahead[i], i), (i, after[i])):
                if left >= 0 and right < n and (pair := (tokens[left], tokens[right])) in rank_of:
                    heapq.heappush(waiting, (rank_of[pair], left, *pair))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many words had to be merged exactly."""
        found = [self.proposed(w) for w in words]
        counts = np.array([len(f) if f else 0 for f in found], np.int64)
        tokens = np.fromiter((t for f in found if f for t in f), np.int64, counts.sum())
        owner = np.repeat(np.arange(len(words)), counts)
        trusted = np.array([f is not None for f in found], bool)
        trusted[owner[~self.sound[tokens]]] = False
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        trusted[owner[inner[~fits[back]]]] = False
        failing = np.flatnonzero(~trusted)
        for i in failing:
            found[i] = self.merged(words[i])
        return found, len(failing)


def _kind(category: str) -> str:
    return category[0] if category[0] in "LN" else "-"


@cache
def _odd_characters(content: str) -> str:
    """A pattern of the code points that the tokenizers library classes otherwise than the rule here.

    Their Unicode versions differ. Only what came after Unicode 3.2 or has changed since is asked for:
    the class of all else, and of what is assigned nowhere yet, is the same in every version in use.
    """
    from tokenizers import Tokenizer

    cut, rule = Tokenizer.from_str(content).pre_tokenizer, regex.compile(WORDS)
    points = [*range(0x80, 0xD800), *range(0xE000, 0x110000)]
    kinds = [(unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)) for c in map(chr, points)]
    since = {p for p, (old, new) in zip(points, kinds) if new != "Cn" and (old == "Cn" or _kind(old) != _kind(new))}
    unknown = "".join(chr(p) for p, (_, new) in zip(points, kinds) if new == "Cn")
    asked = sorted(since | set(map(ord, regex.findall(r"[\p{L}\p{N}]", unknown))))
    text = "".join(f"a{chr(p)}1" for p in asked)  # joins the letter, the digit or neither
    theirs = {span for _, span in cut.pre_tokenize_str(text)}
    ours = {m.span() for m in rule.finditer(text)}
    odd = sorted({asked[a // 3] for a, _ in theirs ^ ours})
    ranges: list[list[int]] = []
    for p in odd:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if odd else r"(?!)"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, put together from remembered words."""

    def __init__(self, content: str, odd: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(content)
        self.known: dict[str, bytes] = {}
        self.rule, self.odd = regex.compile(WORDS), re.compile(odd)
        self.library = Tokenizer.from_str(content).pre_tokenizer
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and self.odd.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.rule.findall(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        # The texts' words in order; a special token stands as the only member of a tuple.
        parts: list[list] = []
        for text in texts:
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                parts.append([w for i, p in enumerate(pieces) for w in ([(p,)] if i % 2 else self._words(p))])
            else:
                parts.append(self._words(text))
        wanted = set().union(*parts)
        for token in [w for w in wanted if isinstance(w, tuple)]:
            self.known[token] = np.array([self.vocabulary.special[token[0]]], "<u4").tobytes()
        missing = [w for w in wanted if w not in self.known]
        if len(self.known) + len(missing) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in wanted if w in self.known}
        found, _ = self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in missing])
        for word, ids in zip(missing, found):
            self.known[word] = np.array(ids, "<u4").tobytes()
        out = [b"".join(map(self.known.__getitem__, words)) for words in parts]
        for word in missing:
            if len(word) > LONGEST_CACHED:
                del self.known[word]
        return out


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id and ids, the token ids of the whole text as little-endian unsigned 32-bit numbers.

    ``tokenizer`` is the path of a tokenizers file; the driver reads it and sends it along.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    source, odd, checksum = spark.sparkContext.broadcast(content), _odd_characters(content), zlib.crc32(content.encode())
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])

    def run(batches):
        encoder = remembered(("bpe", checksum), lambda: Encoder(source.value, odd))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunked(texts, 1 << 20):
                ids = pa.array(encoder(texts[a:b]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(ids: Column, tokenizer: str) -> Column:
    """The text of ids written as by ``encode``; bytes that are no UTF-8 become replacement characters."""
    with open(tokenizer, encoding="utf-8") as file:
        tokens = Vocabulary(file.read()).tokens

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in column], dtype=object)

    return text_of(ids)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of numbers."""

    @F.pandas_udf("array<long>")
    def numbers(column: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x or b"", "<u4").astype(np.int64) for x in column], dtype=object)

    return numbers(ids)


def encoding_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and the hashes of its ids and of the text decoded from them."""
    return encode(docs, tokenizer).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), tokenizer).cast("binary"), 256).alias("decoded_sha256"),
    )
