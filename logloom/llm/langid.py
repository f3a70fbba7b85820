"""Language of texts by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, found by the forward algorithm; that of a text is
the product over its words. The probabilities are learned by expectation maximisation: the forward and
backward sums give how often each piece is expected in the training words of each language.

Words are runs of letters with their marks, in lower case, after the mark of a word's begin; runs over
24 characters are read in parts. A character outside the vocabulary counts as the unknown piece. The
score is the posterior probability of the predicted language with equal priors; ties go to the smaller
name. Null texts and texts without a letter are ``und`` with score 0, and so is every text when nothing
was learned. The model holds languages times pieces numbers.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import materialize

from .common import chunked, drawn, fold, remembered, ship

PER_LANGUAGE = 2_000  # training documents drawn by hash for each language
ROUNDS = 3
SMOOTHING = 0.1  # added to every expected count
LONGEST = 24
CACHED_WORDS = 500_000  # tokens that a Python worker remembers
BEGIN = "▁"
UNKNOWN = 1

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def vocabulary(model: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, the empty piece and the unknown one first."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    kept = (p for p in pieces if regex.fullmatch(f"{BEGIN}?[\\p{{L}}\\p{{M}}]*", p) and p == p.lower() and p)
    return ["", "<unk>", *dict.fromkeys(kept)]


def units(token: str) -> list[str]:
    """Strings to segment in a lower-case token: its letter runs, long ones in parts."""
    out = []
    for word in _WORD.findall(token):
        word = BEGIN + word
        out += [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Pieces:
    """Finds the pieces at all places of many words of one length, by hash.

    Two tables, the second for the pieces whose place in the first is taken; each entry holds the
    whole 64-bit hash, so other strings are told apart.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 18

    def __init__(self, pieces: list[str]):
        found = [(self._hash(p), i) for i, p in enumerate(pieces) if i > UNKNOWN]
        self.longest = max((len(p) for p in pieces[UNKNOWN + 1 :]), default=1)
        self.tables = []
        while found:
            keys, values, late = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int64), []
            slots = self._slots(np.array([h for h, _ in found], np.uint64), len(self.tables))
            for slot, (h, i) in zip(slots.tolist(), found):
                if values[slot]:
                    late.append((h, i))
                else:
                    keys[slot], values[slot] = h, i
            self.tables.append((keys, values))
            found = late

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c)) % (1 << 64)
        return h

    def _slots(self, hashes: np.ndarray, level: int) -> np.ndarray:
        return (_spread(hashes + np.uint64(level)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.zeros(hashes.shape, np.int64)
        for level, (keys, values) in enumerate(self.tables):
            slots = self._slots(hashes, level)
            ids = np.where(keys[slots] == hashes, values[slots], ids)
        return ids

    def ends(self, words: list[str]):
        """For every end j the first begin, and the pieces (word, begin) from there on to j; 0 is none."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
        hashes = np.zeros((len(words), n), np.uint64)
        for j in range(1, n + 1):
            low = max(0, j - self.longest)
            hashes[:, low:j] = hashes[:, low:j] * self.BASE + codes[:, j - 1 : j]
            ids = self.lookup(hashes[:, low:j])
            ids[:, -1] = np.where(ids[:, -1] == 0, UNKNOWN, ids[:, -1])
            yield j, low, ids

    def forward(self, words: list[str], probabilities: np.ndarray) -> np.ndarray:
        """Sum over all segmentations, (word, language); ``probabilities`` is (piece, language)."""
        n = len(words[0])
        alpha = np.zeros((len(words), n + 1, probabilities.shape[1]))
        alpha[:, 0] = 1
        for j, low, ids in self.ends(words):
            alpha[:, j] = (alpha[:, low:j] * probabilities[ids]).sum(1)
        return alpha[:, n]

    def expected(self, words: list[str], counts: np.ndarray, languages: np.ndarray, probabilities: np.ndarray) -> dict:
        """{(language, piece): expected count} of words of one length, each of one language."""
        n, places = len(words[0]), []
        alpha, beta = np.zeros((len(words), n + 1)), np.zeros((len(words), n + 1))
        alpha[:, 0] = beta[:, n] = 1
        for j, low, ids in self.ends(words):
            p = probabilities[ids, languages[:, None]]
            alpha[:, j] = (alpha[:, low:j] * p).sum(1)
            places.append((j, low, ids, p))
        for j, low, _, p in reversed(places):
            beta[:, low:j] += beta[:, j : j + 1] * p
        scale = counts / np.maximum(alpha[:, n], 1e-300)
        size, total = len(probabilities), defaultdict(float)
        for j, low, ids, p in places:
            mass = alpha[:, low:j] * p * (beta[:, j] * scale)[:, None]
            used = mass > 0
            keys, where = np.unique((languages[:, None] * size + ids)[used], return_inverse=True)
            for key, m in zip(keys.tolist(), np.bincount(where, mass[used]).tolist()):
                total[key // size, key % size] += m
        return total


@cache
def _finder(pieces: tuple[str, ...]) -> Pieces:
    return Pieces(list(pieces))


def by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    groups: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        groups[len(word)].append(i)
    for rows in groups.values():
        for first in range(0, len(rows), 4_000):
            part = rows[first : first + 4_000]
            yield part, [words[i] for i in part]


class Model:
    def __init__(self, languages: list[str], pieces: list[str]):
        self.languages, self.pieces, self.key = languages, pieces, uuid.uuid4().hex
        self.probabilities = np.full((len(pieces), max(1, len(languages))), 1 / len(pieces))
        self.probabilities[0] = 0

    def log_units(self, finder: Pieces, words: list[str]) -> np.ndarray:
        """Log probability of every unit in every language."""
        logs = np.empty((len(words), len(self.languages)))
        for rows, part in by_length(words):
            logs[rows] = np.log(np.maximum(finder.forward(part, self.probabilities), 1e-300))
        return logs


class Scores:
    """Remembered log probabilities, of units and of the tokens made up of them.

    One per Python worker and model, so that they last from task to task.
    """

    def __init__(self, model: Model):
        self.model, self.finder = model, _finder(tuple(model.pieces))
        self.clear()

    def clear(self) -> None:
        width = len(self.model.languages)
        self.unit_rows: dict[str, int] = {}
        self.unit_logs = np.zeros((1 << 15, width))
        self.token_rows: dict[str, int] = {}
        self.token_logs = np.zeros((1 << 15, width + 1))  # the last column counts the units

    def _learn_units(self, words: list[str]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.unit_rows]
        size = len(self.unit_rows)
        self.unit_logs = _roomy(self.unit_logs, size + len(fresh))
        self.unit_logs[size : size + len(fresh)] = self.model.log_units(self.finder, fresh) if fresh else 0
        self.unit_rows.update(zip(fresh, range(size, size + len(fresh))))

    def learn(self, tokens: set[str]) -> None:
        missing = [t for t in tokens if t not in self.token_rows]
        if len(self.token_rows) + len(missing) > CACHED_WORDS:
            self.clear()
            missing = list(tokens)
        split = [units(t) for t in missing]
        words = [w for ws in split for w in ws]
        self._learn_units(words)
        owner = np.repeat(np.arange(len(missing)), [len(ws) for ws in split])
        logs = np.zeros((len(missing), self.token_logs.shape[1]))
        if words:
            found = self.unit_logs[[self.unit_rows[w] for w in words]]
            for column in range(found.shape[1]):
                logs[:, column] = np.bincount(owner, found[:, column], len(missing))
            logs[:, -1] = np.bincount(owner, minlength=len(missing))
        size = len(self.token_rows)
        self.token_logs = _roomy(self.token_logs, size + len(missing))
        self.token_logs[size : size + len(missing)] = logs
        self.token_rows.update(zip(missing, range(size, size + len(missing))))

    def of(self, tokens: list[str]) -> np.ndarray:
        return self.token_logs[np.fromiter(map(self.token_rows.__getitem__, tokens), np.int64, len(tokens))].sum(0)


def _roomy(rows: np.ndarray, n: int) -> np.ndarray:
    if n <= len(rows):
        return rows
    return np.concatenate([rows, np.zeros((max(n, 2 * len(rows)) - len(rows), rows.shape[1]))])


def fit(docs: DataFrame, pieces: list[str], folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Learns from about ``per_language`` documents of each language outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held_out))
    sample = drawn(known, "lang", per_language).where("text is not null")

    @F.pandas_udf("array<string>")
    def split(tokens: pd.Series) -> pd.Series:
        return pd.Series([units(t) for t in tokens])

    tokens = sample.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("token"))
    tokens = tokens.groupBy("lang", "token").agg(F.count("*").alias("n"))
    words = tokens.select("lang", "n", F.explode(split("token")).alias("word"))
    words = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    model = Model(languages, pieces)
    for _ in range(rounds if languages else 0):
        given = spark.sparkContext.broadcast(model)

        def expect(batches):
            m = given.value
            finder, number = _finder(tuple(m.pieces)), {x: i for i, x in enumerate(m.languages)}
            total: dict = defaultdict(float)
            for batch in batches:
                n, lang = batch["n"].to_numpy(), batch["lang"].map(number).to_numpy(np.int64)
                for rows, part in by_length(batch["word"].tolist()):
                    for key, mass in finder.expected(part, n[rows], lang[rows], m.probabilities).items():
                        total[key] += mass
            yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=["language", "piece", "mass"])

        sums = words.mapInPandas(expect, "language int, piece int, mass double")
        counts = np.full(model.probabilities.shape, SMOOTHING)
        for r in sums.groupBy("language", "piece").agg(F.sum("mass").alias("mass")).collect():
            counts[r["piece"], r["language"]] += r["mass"]
        counts[0] = 0
        model.probabilities = counts / counts.sum(0)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column struct(lang_pred, score) for a text column."""
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = given.value
        scores, names = remembered(("languages", model.key), lambda: Scores(model)), model.languages
        for batch in batches:
            lang, score = [], []
            texts = [t if isinstance(t, str) else "" for t in batch]
            for a, b in chunked(texts, 1 << 20):
                tokens = [t.lower().split() for t in texts[a:b]]
                scores.learn(set().union(*tokens))
                for words in tokens:
                    total = scores.of(words)
                    if not names or not total[-1]:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    best = int(total[:-1].argmax())
                    lang.append(names[best])
                    score.append(float(1 / np.exp(np.maximum(total[:-1] - total[best], -700)).sum()))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return classify(text)
