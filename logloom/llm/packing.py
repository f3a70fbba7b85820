"""Token pieces of documents, packed into sequences of bounded length.

The packing instance is the histogram of piece lengths (at most ``capacity`` rows), so it is solved
exactly as one instance on the driver whatever the corpus holds: the Martello-Toth dominance reduction
fixes small sets of pieces that no other choice can beat, best fit decreasing packs the rest. Equal
lengths are handled by count. The plan is a list of patterns with multiplicities; pieces find their
place in it by their rank among the pieces of their length.

Null and empty texts are documents of the end token alone. Repeated rows are separate documents.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import materialize

from .common import forget, remembered, ship

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 500_000  # words whose ids a Python worker remembers, and parts of words
RANK_GROUP = 8_192  # pieces of one length that are ranked together

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


# Cutting texts into pieces


# What the vocabulary's rule splits a word into, and the words for which lower-casing and splitting are
# certain to agree with the tokenizer's own: neither special tokens nor characters that compose.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile("[!-;=-~\u00a1-\u012f\u0131-\u024f]+")


class WordIds:
    """Ids of a text, put together from the remembered ids of its words.

    The tokenizer never joins characters across ASCII white space, so the ids of a text are those of
    its words one after another. A word's ids are kept as little-endian 32-bit bytes. Plain words go
    straight to the vocabulary's merges, which are remembered too; all others through the tokenizer.
    More than ``cached_words`` of either are kept only while the texts at hand need them.
    """

    def __init__(self, tokenizer_json: str, cached_words: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merges = self.tokenizer.model
        # Bytes as the printable characters of byte-level vocabularies, by their usual rule.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.visible = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.cached_words = cached_words
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.visible)
        ids = array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()
        self.parts[part] = ids
        return ids

    def _learn(self, missing: list[bytes]) -> None:
        known, parts, other = self.known, self.parts, []
        for word in missing:
            text = word.decode()
            if not _PLAIN.fullmatch(text):
                other.append(word)
                continue
            text = text.lower()
            if text.isalpha():
                known[word] = parts.get(text) or self._part(text)
            else:
                known[word] = b"".join([parts.get(p) or self._part(p) for p in _SPLIT.findall(text)])
        for first in range(0, len(other), 10_000):
            part = other[first : first + 10_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for word, e in zip(part, encoded):
                known[word] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, words: list[list[bytes]]) -> list[bytes]:
        wanted = set().union(*words) if words else set()
        missing = [w for w in wanted if w not in self.known]
        if len(self.known) + len(missing) > self.cached_words:
            self.known = {w: self.known[w] for w in wanted if w in self.known}
        if len(self.parts) > self.cached_words:
            self.parts = {}
        self._learn(missing)
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    ``tokenizer`` is the path of a tokenizers file; the driver reads it and sends it along. A Python worker
    remembers ``cached_words`` words at most: 500,000 take about 200 MB, 50,000 about 80 MB and more time.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as file:
        text = file.read()
    json.loads(text)
    source, checksum = spark.sparkContext.broadcast(text), zlib.crc32(text.encode())
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            *([T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else []),
        ]
    )
    step = capacity * 4
    end = np.array([end_id], "<u4").tobytes()

    def learner():
        forget()
        return WordIds(source.value, cached_words)

    def cut(batches):
        ids_of = remembered(("tokenizer", checksum, cached_words), learner)
        for batch in batches:
            doc_ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            rows = []
            for first in range(0, len(texts), 256):
                words = [t.encode("utf-8", "replace").split() if isinstance(t, str) else [] for t in texts[first : first + 256]]
                for doc_id, ids in zip(doc_ids[first : first + 256], ids_of(words)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        held = ids[at : at + step]
                        row = (doc_id, piece, at // 4, len(held) // 4, zlib.crc32(held))
                        rows.append((*row, np.frombuffer(held, "<u4").astype(np.int64)) if keep_ids else row)
            out = pd.DataFrame(rows, columns=schema.names)
            out["doc_id"] = out["doc_id"].astype(object).where(out["doc_id"].notna(), None)
            yield out

    return docs.select("doc_id", "text").mapInPandas(cut, schema)


# Solving the instance


class _Sizes:
    """Lengths still to pack, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: n for w, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if self.count[size] == 0:
            del self.count[size]
            self.order.pop(bisect_left(self.order, size))

    def largest_up_to(self, bound: int, used: dict[int, int]) -> int | None:
        """The largest size within the bound of which a piece is left besides those used."""
        for i in range(bisect_right(self.order, bound) - 1, -1, -1):
            if self.count[self.order[i]] > used.get(self.order[i], 0):
                return self.order[i]
        return None

    def smallest(self, n: int, used: dict[int, int]) -> list[int]:
        found: list[int] = []
        for size in self.order:
            found += [size] * min(n - len(found), self.count[size] - used.get(size, 0))
            if len(found) == n:
                break
        return found


def dominating_set(sizes: _Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """The pieces to pack with a piece of length ``j``, if that set dominates every other one with it.

    A set dominates another if the other's pieces can be split into parts that each fit into the
    place of a piece of its own (Martello and Toth).
    """
    rest, used = capacity - j, {j: 1}
    best = sizes.largest_up_to(rest, used)
    if best is None:
        return ()
    if best == rest or sum(sizes.smallest(2, used)) > rest or len(sizes.smallest(2, used)) < 2:
        return (best,)
    three = sizes.smallest(3, used)
    if len(three) == 3 and sum(three) <= rest:
        return None
    # At most two more fit. (best, second) dominates unless some pair has both its smaller piece above
    # the second and a sum above the best.
    used[best] = used.get(best, 0) + 1
    second = sizes.largest_up_to(rest - best, used)
    used[best] -= 1
    floor = second or 0
    for y in sizes.order[bisect_right(sizes.order, floor) : bisect_right(sizes.order, rest // 2)]:
        if sizes.count[y] <= used.get(y, 0):
            continue
        with_y = {**used, y: used.get(y, 0) + 1}
        x = sizes.largest_up_to(rest - y, with_y)
        if x is not None and x >= y and x + y > best:
            return None
    return (best,) if second is None else (best, second)


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, Pattern]], dict[int, int]]:
    """Sequences that dominance fixes, as (how many, pattern), and the counts that remain."""
    sizes, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        for j in reversed(list(sizes.order)):
            while j in sizes.count:
                others = dominating_set(sizes, j, capacity)
                if others is None:
                    break
                copies: dict[int, int] = defaultdict(int)
                for size in (j, *others):
                    copies[size] += 1
                times = min(sizes.count[size] // n for size, n in copies.items())
                for size, n in copies.items():
                    sizes.take(size, n * times)
                fixed.append((times, tuple(sorted(copies.items(), reverse=True))))
                changed = True
    return fixed, sizes.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit decreasing over counted lengths: sequences of equal content are kept as one group."""
    groups: dict[int, list[tuple[int, Pattern]]] = {}  # by room left
    rooms: list[int] = []

    def add(room: int, n: int, pattern: Pattern) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((n, pattern))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in rooms[bisect_left(rooms, size) :]:
            if not left:
                break
            fit, waiting = room // size, groups.pop(room)
            rooms.pop(bisect_left(rooms, room))
            for n, pattern in waiting:
                full = min(n, left // fit)
                last = min(left - full * fit, fit) if full < n else 0
                left -= full * fit + last
                add(room - fit * size, full, (*pattern, (size, fit)))
                add(room - last * size, 1 if last else 0, (*pattern, (size, last)))
                add(room, n - full - bool(last), pattern)
        fit = capacity // size
        add(capacity - fit * size, left // fit, ((size, fit),))
        add(capacity - left % fit * size, 1 if left % fit else 0, ((size, left % fit),))
    return [group for room in rooms for group in groups[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[tuple[int, Pattern]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted: where ranks of a length go.

    At most a few patterns arise per distinct length, so the table is bounded by the capacity.
    """
    rows, ranks, sequence = [], defaultdict(int), 0
    for times, pattern in patterns:
        offset = 0
        for size, copies in pattern:
            rows.append((size, ranks[size], sequence, copies, offset))
            ranks[size] += times * copies
            offset += size * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# Placing the pieces


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Other lengths stop the job. The input is read several times: give a stored table.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(w is None or not 1 <= w <= capacity for w in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    found = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    groups = max(1, -(-max(counts.values(), default=1) // RANK_GROUP))
    row = [c for c in pieces.columns]
    keyed = pieces.select(
        F.struct(*row).alias("_row"), F.col("length").alias("_w"), F.xxhash64(*row).alias("_h")
    ).withColumn("_g", F.pmod("_h", F.lit(groups)))
    before = (
        keyed.groupBy("_w", "_g")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("_w").orderBy("_g")) - F.col("_n"))
        .drop("_n")
    )
    ranked = keyed.join(before, ["_w", "_g"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_w", "_g").orderBy("_h")) - 1
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = found.value
        w, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.zeros((len(w), 2), np.int64)
        for size in np.unique(w):
            mine = np.flatnonzero(w == size)
            rows = t[np.searchsorted(t[:, 0], size) : np.searchsorted(t[:, 0], size, "right")]
            at = rows[np.searchsorted(rows[:, 1], r[mine], "right") - 1]
            nth = r[mine] - at[:, 1]
            out[mine, 0] = at[:, 2] + nth // at[:, 3]
            out[mine, 1] = at[:, 4] + nth % at[:, 3] * size
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_at", place("_w", "_rank")).select("_row.*", "_at.sequence_id", "_at.offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, cached_words: int = CACHED_WORDS
) -> DataFrame:
    """The pieces of all documents with their sequence and the offset in it."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity, end_id, cached_words=cached_words), "pieces"), capacity)
