"""Toxic texts by a support vector machine with a subsequence string kernel.

The kernel (Lodhi et al., 2002) compares two strings by the subsequences of three letters they share;
every character between the letters, inserted ones included, lowers the weight by ``DECAY``, and up to
``GAPS`` may lie between two letters. So "i-d.iot" and "idiiot" stay close to the plain word. Strings
are the words of a text (runs of single letters, "i d i o t", count as one word as well); long ones are
read through overlapping windows. Landmarks give a Nyström approximation of the kernel, in which a
linear machine is trained. As every landmark is a known string, the machine folds into one weight per
subsequence, so that a word costs the same whatever the number of landmarks.

Training sees the words of labelled sentences. Words with parts that toxic documents use far more
often (G test) are positive examples, together with versions that have characters inserted; words of
clean ones are negative: the commonest, and those that the machine takes for toxic at first. A text is judged by the margins
of its three worst words, which a logistic scaling maps to 0..1.

Null, empty and blank texts have no word and get the score of the lowest margin. Without a word to
learn from every score is 0.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import materialize

from .common import chunked, give_back, labelled_ids, remembered, ship

PER_CLASS = 4_000  # labelled documents to learn from, each of toxic and clean
POSITIVE_WORDS, NEGATIVE_WORDS = 300, 10_000
LEAST_SEEN = 2  # different words before a part that is to be evidence
MINING_ROUNDS = 3  # after each, the clean words that the machine takes for toxic join the negatives
LANDMARKS = 192
COST = 5.0  # of errors against the size of the margin
POOLED = 3  # words of a text that its score is made of
DECAY, GAPS = 0.7, 2
WINDOW = 24  # characters of a long word that are read at once, half of them again
CACHED_WORDS = 500_000
SYMBOLS = 64
FEATURES = SYMBOLS**3
BEGIN = "\x02"  # put before every word, a symbol of its own
HIGHEST = 1.5  # margins are clipped to it
TOGETHER = 1_000  # words that the training takes at a time, as the driver holds them

_PATTERNS = [(a, b) for a in range(1, GAPS + 2) for b in range(1, GAPS + 2)]
_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){3,}(?!\S)")


@cache
def _symbol_of() -> np.ndarray:
    """a-z are 0..25, other letters share the rest, what is no letter is -1."""
    table = np.full(0x3000, -1, np.int16)
    for code in range(0x3000):
        char = chr(code)
        if char.isalpha():
            table[code] = code - 97 if "a" <= char <= "z" else 26 + code % (SYMBOLS - 27)
    return table


def encode(words: list[str]) -> np.ndarray:
    """One row of symbols per word, the mark of its begin first; -1 where there is no letter."""
    table = _symbol_of()
    words = [BEGIN + w for w in words]
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4")
    symbols = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], 26 + codes % (SYMBOLS - 27))
    symbols = np.where(codes == ord(BEGIN), SYMBOLS - 1, symbols)
    out = np.full((len(words), max(3, int(lengths.max(initial=0)))), -1, np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    out[row, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = symbols
    return out


def subsequences(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word all its subsequences, sorted, and their weights; -1 and 0 where there is none.

    Repeated ones keep a single entry with the summed weight.
    """
    n, width = symbols.shape
    found = []
    for a, b in _PATTERNS:
        if a + b < width:
            x, y, z = symbols[:, : width - a - b], symbols[:, a : width - b], symbols[:, a + b :]
            key = ((x * SYMBOLS + y) * SYMBOLS + z) * 8 + (a + b - 2)
            found.append(np.where((x >= 0) & (y >= 0) & (z >= 0), key, -1))
    keys = np.sort(np.concatenate(found, 1), 1)
    index = keys >> 3
    value = np.where(keys >= 0, (DECAY ** np.arange(8))[keys & 7], 0.0)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    at = np.flatnonzero(new.ravel())
    total = np.zeros(keys.size)
    total[at] = np.add.reduceat(value.ravel(), at)
    return np.where(new, index, -1), total.reshape(keys.shape)


def _norms(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values**2).sum(1))


@cache
def _least_norm() -> float:
    """That of a five-letter word: shorter ones, having few subsequences, would seem alike too easily."""
    return float(_norms(subsequences(encode(["abcde"]))[1])[0])


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    li, lv = subsequences(encode(landmarks))
    norms = np.maximum(_norms(lv), _least_norm())
    out = np.empty((len(words), len(landmarks)), np.float32)
    dense = np.zeros(FEATURES + 1, np.float32)
    for first in range(0, len(words), TOGETHER):
        wi, wv = subsequences(encode(words[first : first + TOGETHER]))
        own = np.maximum(_norms(wv), _least_norm())
        for j in range(len(landmarks)):
            dense[li[j]] = lv[j] * (li[j] >= 0)
            dense[-1] = 0
            out[first : first + TOGETHER, j] = (dense[wi] * wv).sum(1) / own / norms[j]
            dense[li[j]] = 0
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights and bias of the linear machine with squared hinge loss, by Newton steps."""
    width = x.shape[1] + 1
    ridge = np.diag(np.r_[np.ones(width - 1), 1e-6])
    w = np.zeros(width)
    for _ in range(rounds):
        active = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        squares, right = ridge.copy(), np.zeros(width)
        for first in range(0, len(active), TOGETHER):
            rows = active[first : first + TOGETHER]
            xa = np.c_[x[rows], np.ones(len(rows))]
            weighted = 2 * (xa * cost[rows][:, None]).T
            squares += weighted @ xa
            right += weighted @ y[rows]
        new = np.linalg.solve(squares, right)
        if np.abs(new - w).max() < 1e-8:
            break
        w = 0.5 * (w + new) if _ > 20 else new
    return w


@dataclass
class Machine:
    """Weight per subsequence, bias, and the numbers of the scaling: a slope per pooled word, an offset."""

    weights: np.ndarray
    bias: float
    slopes: tuple[float, ...] = (1.0,) + (0.0,) * (POOLED - 1)
    offset: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def products(self, symbols: np.ndarray) -> np.ndarray:
        """Per word the sum of the weights of its subsequences, before the word's norm."""
        n, width = symbols.shape
        total = np.zeros(n, np.float32)
        symbols = symbols.astype(np.int32)
        places = [np.where(symbols >= 0, symbols * SYMBOLS**power, FEATURES) for power in (2, 1, 0)]
        for a, b in _PATTERNS:
            if a + b < width:
                key = places[0][:, : width - a - b] + places[1][:, a : width - b] + places[2][:, a + b :]
                total += self.weights[np.minimum(key, FEATURES)].sum(1) * np.float32(DECAY ** (a + b - 2))
        return total

    def margins(self, words: list[str]) -> np.ndarray:
        """From the bias, that of a word like no toxic one, to HIGHEST."""
        out = np.full(len(words), self.bias)
        for first in range(0, len(words), 8_000):
            symbols = encode(words[first : first + 8_000])
            product = self.products(symbols)
            alike = np.flatnonzero(product > 0)  # the others need no norm
            if len(alike):
                norm = np.maximum(_norms(subsequences(symbols[alike])[1]), _least_norm())
                out[first + alike] += product[alike] / norm
        return np.minimum(out, HIGHEST)


def gapped(word: str) -> list[str]:
    """Versions of a word with characters inserted."""
    middle = len(word) // 2
    return [
        ".".join(word),
        "-".join(word),
        word[:middle] + "*" + word[middle:],
        word[:middle] + "x" + word[middle:],
        word[: middle + 1] + word[middle:],
        word[0] + "_" + word[1:],
    ]


def train(positive: list[str], negatives: dict[str, int], hardest: list[str] = (), landmarks: int = LANDMARKS) -> Machine:
    """A machine that tells positive words, gapped ones included, from negative ones with their counts.

    Landmarks are spread over the positive words; the others are the hardest negatives, as far as these
    are known, and the commonest. Common words count more than rare ones.
    """
    positive = [w[:WINDOW] for w in positive]
    versions = positive + [v[:WINDOW] for w in positive for v in gapped(w)]
    half = spread(positive, landmarks // 2)
    others = list(dict.fromkeys(w[:WINDOW] for w in [*hardest, *negatives]))[: landmarks - len(half)]
    return _train(versions, [w[:WINDOW] for w in negatives], half + others, np.log2(1 + np.array([*negatives.values()], float)))


def spread(words: list[str], n: int) -> list[str]:
    """Up to ``n`` of the words, each next one the least like those before it."""
    if len(words) <= n:
        return list(dict.fromkeys(words))
    similar = kernel(words, words)
    chosen, nearest = [0], similar[:, 0].copy()
    while len(chosen) < n:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, similar[:, chosen[-1]])
    return [words[i] for i in dict.fromkeys(chosen)]


def _train(positive: list[str], negative: list[str], landmarks: list[str], negative_cost: np.ndarray) -> Machine:
    chosen = list(dict.fromkeys(landmarks))
    values, vectors = np.linalg.eigh(kernel(chosen, chosen).astype(np.float64))
    kept = values > 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = COST * np.r_[np.ones(len(positive)), negative_cost]
    words = positive + negative
    x = np.empty((len(words), root.shape[1]))
    for first in range(0, len(words), TOGETHER):
        x[first : first + TOGETHER] = kernel(words[first : first + TOGETHER], chosen) @ root
    w = svm(x, y, cost)
    scale = root @ w[:-1]
    index, value = subsequences(encode(chosen))
    scale = scale / np.maximum(_norms(value), _least_norm())
    folded = np.zeros(FEATURES + 1)
    np.add.at(folded, index.ravel(), (value * scale[:, None] * (index >= 0)).ravel())
    folded[-1] = 0
    return Machine(folded.astype(np.float32), float(w[-1]))


def words_of(text: str | None) -> set[str]:
    """Distinct words to score: those between white space, and spelt-out ones."""
    if not isinstance(text, str):
        return set()
    text = text.lower()
    words = set(text.split())
    words.update("".join(m.group().split()) for m in _SPACED.finditer(text))
    for word in [w for w in words if len(w) > WINDOW]:
        words.remove(word)
        words.update(word[i : i + WINDOW] for i in range(0, max(1, len(word) - WINDOW // 2), WINDOW // 2))
    return words


def worst(words: set[str], margin_of_word, lowest: float) -> list[float]:
    """The POOLED largest margins of words that differ in their letters, largest first.

    Texts of fewer words are filled up with the lowest margin.
    """
    found, seen = [], set()
    for word in nlargest(3 * POOLED, words, key=margin_of_word):
        letters = "".join(filter(str.isalpha, word))
        if letters not in seen and len(found) < POOLED:
            seen.add(letters)
            found.append(margin_of_word(word))
    return found + [lowest] * (POOLED - len(found))


def margins_of(machine) -> Column:
    """A function of a text column: the largest margins of its words."""

    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = remembered(("margins", machine.value.key), dict)
        for batch in batches:
            texts, out = [t if isinstance(t, str) else "" for t in batch], []
            for a, b in chunked(texts, 1 << 20):
                sets = [words_of(t) for t in texts[a:b]]
                wanted = set().union(*sets)
                missing = [w for w in wanted if w not in known]
                if len(known) + len(missing) > CACHED_WORDS:
                    known.clear()
                    missing = list(wanted)
                known.update(zip(missing, machine.value.margins(missing).tolist()))
                out += [worst(s, known.__getitem__, machine.value.bias) for s in sets]
            yield pd.Series(out)

    return margins


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and offset of P(toxic) as a logistic function of the margins, with Platt's targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.c_[margins, np.ones(len(margins))]
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - target) + ridge @ w)
        w = w - step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return tuple(w[:-1].tolist()), float(w[-1])


def _telling(counts: DataFrame) -> DataFrame:
    """Rows whose ``pos`` is far above what ``neg`` lets expect, with the statistic ``g``.

    The bound of the test grows with the number of rows tested. ``pos`` has no other floor than
    ``LEAST_SEEN``: a rare insult follows few different words, however many documents there are.
    """
    pos, neg, tested = (float(x or 0) for x in counts.agg(F.sum("pos"), F.sum("neg"), F.count("*")).first())
    seen = F.col("pos") + F.col("neg")

    def part(x, share: float):
        return F.when(x > 0, x * F.log(x / (seen * share))).otherwise(0.0)

    g = 2 * (part(F.col("pos"), max(pos, 1) / max(pos + neg, 1)) + part(F.col("neg"), max(neg, 1) / max(pos + neg, 1)))
    often = F.col("pos") >= LEAST_SEEN
    return counts.withColumn("g", g).where(often & (F.col("g") > 10.8 + 2 * math.log(max(1.0, tested))) & (F.col("pos") * neg > 8 * F.col("neg") * pos))


def toxic_words(labelled: DataFrame, positives: int) -> tuple[list[str], DataFrame | None]:
    """Words that tell toxic documents apart, and the words of clean ones with their counts.

    A word counts once for each word it follows, so that copies of one sentence count once. Inflected
    and compound forms are found by the parts of 4 to 6 letters they share, with ``^`` for a word's begin.
    """
    sentence = F.explode(F.split(F.lower("text"), r"[.!?\n]+"))
    words = labelled.select("label", sentence.alias("sentence")).select(
        "label", F.concat(F.array(F.lit("^")), F.split(F.trim("sentence"), r"\s+")).alias("words")
    )
    pairs = words.select("label", F.explode(F.arrays_zip("words", F.expr("slice(words, 2, size(words))").alias("next"))).alias("p"))
    counts = (
        pairs.select("label", F.col("p.words").alias("previous"), F.regexp_replace("p.next", r"^\P{L}+|\P{L}+$", "").alias("word"))
        .where("length(word) >= 3")
        .distinct()
        .groupBy("word")
        .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    )
    counts = materialize(counts, "word-counts")
    anchored = F.concat(F.lit("^"), F.col("word"))

    def parts_of(size: int):
        places = F.sequence(F.lit(1), F.length("word") + 1)
        return F.filter(F.transform(places, lambda i: anchored.substr(i, F.lit(size))), lambda part: F.length(part) == size)

    grams = F.concat(*[parts_of(size) for size in (4, 5, 6)])
    parts = counts.select("pos", "neg", F.explode(F.array_distinct(grams)).alias("part"))
    parts = materialize(parts.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "parts")
    strong = [r["part"] for r in _telling(parts).orderBy(F.desc("g"), "part").limit(positives).collect()]
    if not strong:
        return [], None
    holds = anchored.rlike("|".join(re.escape(part) for part in strong))
    telling = counts.where(holds & (F.col("pos") > 4 * F.col("neg")))
    positive = [r["word"] for r in telling.orderBy(F.desc("pos"), "word").limit(positives).collect()]
    clean = counts.where((F.col("neg") > 0) & ~(holds & (F.col("pos") > F.col("neg"))))
    return positive, clean.select("word", "neg")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Machine | None:
    """Learns from about ``per_class`` labelled documents of each class outside the held-out fold."""
    ship(docs.sparkSession)
    ids = labelled_ids(labels, "toxic", folds, held_out, per_class)
    texts = docs.select("doc_id", "text").where("text is not null")
    labelled = materialize(texts.join(F.broadcast(ids), "doc_id"), "labelled")
    positive, clean = toxic_words(labelled, POSITIVE_WORDS)
    if not positive:
        return None
    common = clean.orderBy(F.desc("neg"), "word").limit(NEGATIVE_WORDS).collect()
    negatives = {r["word"]: r["neg"] for r in common}
    machine = train(positive, negatives)
    for _ in range(MINING_ROUNDS):
        margins = margins_of(docs.sparkSession.sparkContext.broadcast(machine))
        scored = clean.withColumn("margin", F.get(margins("word"), F.lit(0))).where("margin > -0.9")
        hard = scored.orderBy(F.desc("margin"), F.desc("neg"), "word").limit(NEGATIVE_WORDS // 2).collect()
        negatives |= {r["word"]: r["neg"] for r in hard}
        machine = train(positive, negatives, [r["word"] for r in hard])
    give_back()
    margins = margins_of(docs.sparkSession.sparkContext.broadcast(machine))
    rows = labelled.select("label", margins("text").alias("margins")).collect()
    machine.slopes, machine.offset = platt(np.array([r["margins"] for r in rows]), np.array([r["label"] for r in rows]))
    return machine


def score(docs: DataFrame, machine: Machine | None, text: str = "text") -> Column:
    """Column with the toxicity of the text, 0 to 1."""
    if machine is None:
        return F.lit(0.0)
    ship(docs.sparkSession)
    margins = margins_of(docs.sparkSession.sparkContext.broadcast(machine))(text)
    slopes = F.array(*[F.lit(w) for w in machine.slopes])
    total = F.aggregate(F.zip_with(margins, slopes, lambda m, w: m * w), F.lit(machine.offset), lambda x, y: x + y)
    return 1 / (1 + F.exp(-total))
