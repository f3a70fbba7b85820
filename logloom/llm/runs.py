"""Periodic runs of words: stretches that repeat with a smallest period, found from seeds on diagonals.

A run is a stretch of consecutive words in which words ``period`` apart are equal, the period being the
smallest such, of at least ``least`` words and two periods, that no neighbour extends. On the diagonal
of its period (word i against word i + period) it is a row of equal words of guaranteed length: for
periods of ``least`` / 2 to ``least`` no less than least / 2, and of [K, 2K) no less than K. So the k-grams
of each of these classes are indexed, k being the largest power of two within two thirds of the overlap,
and every occurrence at one of the places that the overlap can't miss is paired with the occurrences of
the same k-gram in the same document whose distance is in the class: a bounded number for each word. The
pairs are seeds. For each lag the furthest word covered so far is kept; a seed within it is dropped, any
other is extended both ways to the full row. Of equal stretches the smallest period stays: a stretch of
two periods or more that has a smaller one is that one's run as well.

All steps are array operations over many documents at once, laid end to end with a mark between them that
equals no word. Only documents with a repeated k-gram of the shortest overlap enter; the hashes that
decide this can let a document in, but leave none out. All else compares words exactly.

Null and empty texts have no words and no runs. Very long texts are treated whole, alone in a batch. Repeated
rows and equal texts are treated alike; runs tied in length are told apart by start, then period. An empty
table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, ship
from .cws import mix, word_hashes

LEAST = 12
CHUNK = 1 << 21  # characters treated at once

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def repeating(texts: list[bytes], overlap: int) -> np.ndarray:
    """Numbers of the texts in which some ``overlap`` words may stand twice."""
    h, doc = word_hashes(texts)
    room = len(h) - overlap + 1
    if room < 2:
        return np.zeros(0, np.int64)
    gram = mix(doc[:room].astype(np.uint64) + np.uint64(1))
    for j in range(overlap):
        gram = gram * np.uint64(0xD1342543DE82EF95) + h[j : room + j]
    gram = gram[doc[:room] == doc[overlap - 1 :]]
    owner = doc[:room][doc[:room] == doc[overlap - 1 :]]
    order = np.argsort(gram, kind="stable")
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    return np.unique(owner[order[same]])


class Grams:
    """Numbers of the k-grams at each place of a row of words, for k = 1, 2, 4 and so on; equal if and only if the words are."""

    def __init__(self, words: np.ndarray):
        self.at = [words]

    def __getitem__(self, power: int) -> np.ndarray:
        while len(self.at) <= power:
            last, k = self.at[-1], 1 << (len(self.at) - 1)
            room = max(0, len(last) - k)
            pairs = last[:room] * (int(last.max(initial=0)) + 1) + last[k : k + room]
            self.at.append(np.unique(pairs, return_inverse=True)[1])
        return self.at[power]

    def equal_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from places i and j on (i < j)."""
        return self._reach(i, j, 1)

    def equal_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal just before places i and j (i < j)."""
        return self._reach(i, j, -1)

    def _reach(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        i, j, reach = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        power, going = 0, np.arange(len(i))
        while len(going):  # up: double the step while it holds, ...
            going = going[self._step(i, j, reach, going, power, way)]
            power += 1
        for power in range(power - 1, -1, -1):  # ... down: what is left is shorter than the step that failed
            self._step(i, j, reach, np.arange(len(i)), power, way)
        return reach

    def _step(self, i, j, reach, which, power, way) -> np.ndarray:
        k, numbers = 1 << power, self[power]
        a, b = (i[which], j[which]) if way > 0 else (i[which] - k, j[which] - k)
        holds = (a >= 0) & (b < len(numbers))
        holds[holds] = numbers[a[holds]] == numbers[b[holds]]
        moved = which[holds]
        i[moved] += way * k
        j[moved] += way * k
        reach[moved] += k
        return holds


def _seeds(numbers: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j with equal numbers, i a multiple of ``step``, low <= j - i <= high."""
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    sorted_numbers = numbers[order]
    again = np.flatnonzero(sorted_numbers[1:] == sorted_numbers[:-1])
    if not len(again):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = n + high + 1
    keys = sorted_numbers * span + order
    anchors = order[np.unique(np.r_[again, again + 1])]
    anchors = np.sort(anchors[anchors % step == 0])
    base = numbers[anchors] * span + anchors
    first, end = np.searchsorted(keys, base + low), np.searchsorted(keys, base + high, "right")
    counts = end - first
    i = np.repeat(anchors, counts)
    within = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
    return i, order[np.repeat(first, counts) + within]


def _rows(grams: Grams, i: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The full rows of equal words on their diagonals that hold the seeds: begin, end (exclusive), lag."""
    found = []
    order = np.lexsort((i, lag))
    i, lag = i[order], lag[order]
    while len(i):
        # The next seed of each lag; what its row covers needs no extension again.
        first = np.flatnonzero(np.r_[True, lag[1:] != lag[:-1]])
        a, q = i[first], lag[first]
        begin = a - grams.equal_before(a, a + q)
        end = a + grams.equal_after(a, a + q)
        found.append((begin, end, q))
        furthest = np.repeat(end, np.diff(np.r_[first, len(i)]))
        left = i + k > furthest
        i, lag = i[left], lag[left]
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3


def runs_in(words: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, by start and period, in a row of documents' words.

    ``words`` are numbers; between documents stands a number of its own. No document has more than
    ``longest`` words.
    """
    grams, found = Grams(words), []
    low, overlap = 1, (least + 1) // 2
    high = least - 1
    while low <= longest // 2:
        power = max(0, (overlap * 2 // 3).bit_length() - 1)
        k = 1 << power
        i, j = _seeds(grams[power], overlap - k + 1, low, high)
        begin, end, lag = _rows(grams, i, j - i, k)
        length = end - begin + lag
        whole = length >= np.maximum(least, 2 * lag)
        found.append((begin[whole], length[whole], lag[whole]))
        low, high, overlap = high + 1, 2 * high + 1, high + 1
    start, length, period = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Of each text: number of words, runs, and the words kept (no more than one period of each run)."""
    hits = repeating(texts, (least + 1) // 2)
    split: dict[int, list[bytes]] = {d: texts[d].split() for d in hits.tolist()}
    out: list = []
    for text in texts:
        words = text.split()
        out.append((len(words), [], b" ".join(words)))
    if not split:
        return out
    known: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in split.values()], np.int64)
    words = np.empty(lengths.sum() + len(lengths), np.int64)
    firsts = np.cumsum(lengths + 1) - lengths - 1
    for ws, at in zip(split.values(), firsts.tolist()):
        words[at : at + len(ws)] = [known.setdefault(w, len(known)) for w in ws]
    words[firsts + lengths] = len(known) + np.arange(len(lengths))
    start, length, period = runs_in(words, int(lengths.max()), least)
    # Covered places by counting where droppings begin and end.
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    owner = np.searchsorted(firsts, start, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(lengths) + 1))
    for number, (d, ws) in enumerate(split.items()):
        a, b = bounds[number], bounds[number + 1]
        if a < b:
            at = firsts[number]
            rows = list(zip((start[a:b] - at).tolist(), length[a:b].tolist(), period[a:b].tolist()))
            keep = kept[at : at + len(ws)].tolist()
            out[d] = (len(ws), rows, b" ".join([w for w, k in zip(ws, keep) if k]))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period) and collapsed, the text without repetitions.

    ``collapsed`` holds the words outside of runs and the first period of each run, joined by one space; a
    word within any run after that run's first period is left out.
    """
    ship(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *T.StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string").fields,
        ]
    )
    fields = ("start", "length", "period")
    kind = pa.list_(pa.struct([pa.field(f, pa.int64()) for f in fields]))

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            for a, b in chunked(texts, CHUNK):
                found = find(texts[a:b], least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([[dict(zip(fields, r)) for r in f[1]] for f in found], kind),
                        pa.array([f[2].decode() for f in found], pa.string()),
                    ],
                    schema.fieldNames(),
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, the words of every tenth document (by the hash of its id) made periodic from some word on.

    With h the crc32 of the decimal id and g = h div 10: if h is divisible by 10, each of the n words from
    place a = g mod n on becomes the word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null id
    has no hash, and its text stays.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), h.alias("h"), F.expr("1L").alias("one"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    parts = parts.withColumn("w", F.when(chosen, words))
    parts = parts.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    parts = parts.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    places = F.expr("concat(slice(w, 1, cast(a as int)), flatten(array_repeat(slice(w, cast(a + 1 as int), cast(p as int)), cast((n - a) div p + 1 as int))))")
    periodic = F.array_join(F.slice(places, F.lit(1), F.col("n").cast("int")), " ")
    return parts.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run, and the hashes of all runs and of the collapsed text."""
    found = periodic_runs(docs)
    longest = F.expr("aggregate(slice(runs, 2, size(runs)), runs[0], (m, r) -> if(r.length > m.length, r, m))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    best: Column = F.when(F.size("runs") > 0, longest)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
