"""Near-duplicate documents by improved consistent weighted sampling (Ioffe, 2010).

A text is the weighted set of its five-word shingles (lower case, words between ASCII white space; a
shorter text is one shingle). The weight of a shingle is its count in the text times an inverse
document frequency scaled to 1..2, so that what very many documents share counts half as much as what
only one has, and large groups of copies stay similar. Document frequencies cover all documents; they
come from a count-mean-min sketch of fixed size, whose expected noise is taken off.

Every distinct text draws ``BANDS * ROWS`` consistent samples: two texts agree in one with a
probability equal to their weighted Jaccard similarity. Texts that agree in all rows of a band meet in
a bucket. There each is first compared with the bucket's hub, which is another text in every band, by
the exact weighted Jaccard similarity. Linked texts form a class by connected components; a bucket
within one class is done, which spares the pairs of a group of copies. In all other buckets (a shared
template brings texts together that are not similar) every two texts of different classes are compared,
block by block inside the tasks, by matrix products that give an upper bound of what they share; those that
pass are verified there, unless links found before join their classes already. So every similar pair that
meets in a bucket ends in one class, and a task returns a spanning forest of the classes it holds, not their
pairs. The members of a bucket's largest class are not compared with each other.

Equal texts are always one class, and so are texts that differ only in case and white space. Null texts
count as empty; all texts without a word are one class. Repeated rows are classed like their first. A null
doc_id is kept and counts as larger than all others.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import materialize

from .common import chunked, forget, give_back, ship, starts_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
CELLS = 1 << 20  # of each of the two rows of the frequency sketch
PART = 1 << 12  # cells that are summed together
BLOCK = 512  # texts of a bucket that are compared with as many others at a time
SHINGLES = 1 << 18  # that are held together in such a comparison, or one text
CHUNK = 1 << 19  # characters whose shingles are made at a time
DRAWS = 1 << 16  # table of random draws, indexed by hash

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_PLACE = 0xBEA225F9EB34556D


# Shingles


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    value = mix(np.arange(1, 257, dtype=_U) * _GOLD)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        base = 0xD1342543DE82EF95
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, b, _U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the number of the text it stands in."""
    value, space = _byte_values()
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(space[data].view(np.int8))
    first, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    up, down = _powers(len(data))
    sums = np.cumsum(value[data] * up)
    hashes = mix((sums[end - 1] - sums[first - 1]) * down[first] + (end - first).astype(_U))
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(bounds, first, "right") - 1


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, count; sorted by text and hash."""
    h, doc = word_hashes(texts)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    room = max(0, len(h) - words + 1)
    s = np.zeros(room, _U)
    for j in range(words if room else 0):
        s += h[j : room + j] * _U(_PLACE * (2 * j + 1) % (1 << 64))
    whole = np.flatnonzero(doc[:room] == doc[words - 1 :]) if room else np.zeros(0, np.int64)
    s, owner = mix(s[whole]), doc[whole]
    counts = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        begins = np.cumsum(counts) - counts
        extra = [sum(int(x) * (2 * j + 1) for j, x in enumerate(h[begins[d] : begins[d] + counts[d]])) for d in short]
        s, owner = np.r_[s, mix(np.array([x % (1 << 64) for x in extra], _U))], np.r_[owner, short]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    return owner[at], s[at], np.diff(np.r_[at, len(s)])


def digest(text: str) -> Column:
    """Of the text as it is; texts without a word count as empty."""
    return F.unhex(F.md5(F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.col(text)).otherwise(F.lit("")).cast("binary")))


def _lower(texts) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


# Document frequencies


def _cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = _U(64 - CELLS.bit_length() + 1)
    return (s >> shift).astype(np.int64), ((s * _GOLD) >> shift).astype(np.int64) + CELLS


def count_shingles(docs: DataFrame, words: int = WORDS) -> tuple[int, np.ndarray]:
    """Number of documents, and for each cell of the sketch the documents counted in it."""

    def count(batches):
        forget()
        total, cells = 0, np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            texts = _lower(batch["text"])
            total += len(texts)
            for a, b in chunked(texts, CHUNK):
                _, s, _ = shingles(texts[a:b], words)
                for c in _cells(s):
                    cells += np.bincount(c, minlength=2 * CELLS)
        if total:
            parts = [p for p in range(2 * CELLS // PART) if cells[p * PART : (p + 1) * PART].any()]
            blobs = [zlib.compress(cells[p * PART : (p + 1) * PART].astype("<u4").tobytes(), 1) for p in parts]
            yield pd.DataFrame({"part": [-1, *parts], "n": [total] + [0] * len(parts), "cells": [b"", *blobs]})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        docs_in: dict[int, int] = {}
        for batch in batches:
            for part, n, blob in zip(batch["part"].tolist(), batch["n"].tolist(), batch["cells"]):
                docs_in[part] = docs_in.get(part, 0) + n
                if blob:
                    mine = np.frombuffer(zlib.decompress(blob), "<u4" if part < 1 << 20 else "<u8").astype(np.int64)
                    held[part] = held[part] + mine if part in held else mine
        yield pd.DataFrame(
            {
                "part": list(docs_in),
                "n": list(docs_in.values()),
                "cells": [zlib.compress(held[p].astype("<u8").tobytes(), 1) if p in held else b"" for p in docs_in],
            }
        )

    schema = "part int, n long, cells binary"
    sums = docs.select("text").mapInPandas(count, schema).repartition("part").mapInPandas(add, schema)
    total, cells = 0, np.zeros(2 * CELLS, np.int64)
    for row in sums.collect():  # at most 2 * CELLS / PART + 1 rows
        total += row["n"]
        if row["part"] >= 0:
            cells[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(zlib.decompress(row["cells"]), "<u8")
    return total, cells


def scaled_idf(total: int, cells: np.ndarray) -> np.ndarray:
    """Per cell 1 + ln(documents / frequency) / ln(documents), between 1 and 2."""
    out = np.full(2 * CELLS, 2, np.float32)
    for first in range(0, 2 * CELLS if total >= 2 else 0, CELLS):
        counted = cells[first : first + CELLS].sum()
        for part in range(first, first + CELLS, PART):  # as the driver should not hold several copies of the sketch
            row = cells[part : part + PART]
            noise = (counted - row) / (CELLS - 1)
            frequency = np.clip(row - noise, 1, total)
            out[part : part + PART] = 1 + np.log(total / frequency) / np.log(total)
    return out


def weights(s: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _cells(s)
    return counts.astype(np.float32) * np.maximum(idf[a], idf[b])


# Samples


@cache
def _draws() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20100)
    r, c, beta = rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS), rng.random(DRAWS)
    # ln a = ln c - r (t - beta + 1); 64 is added, to make it a positive float, whose bits sort like it.
    return tuple(x.astype(np.float32) for x in (1 / r, beta, r, np.log(c) - r * (1 - beta) + 64))


def samples(owner: np.ndarray, s: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """One row per distinct owner (in order) with n consistent samples of its weighted shingles."""
    inverse_r, beta, r, constant = _draws()
    at, log_w = starts_of(owner), np.log(w)
    low = s & _U(0xFFFFFFFF)
    out = np.empty((len(at), n), _U)
    for i in range(n):
        draw = ((s * (mix(np.array([i + 1], _U))[0] | _U(1))) >> _U(48)).astype(np.int64)
        step = np.floor(log_w * inverse_r[draw] + beta[draw])
        log_a = constant[draw] - r[draw] * step
        out[:, i] = np.minimum.reduceat((log_a.view(np.uint32).astype(_U) << _U(32)) | low, at)
    return out


def band_keys(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = []
    for b in range(bands):
        key = np.full(len(sample), b + 1, _U)
        for row in range(b * rows, (b + 1) * rows):
            key = mix(key * _GOLD + sample[:, row])
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, digest of the text, keys of the bands (none for texts without a word)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("digest", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches):
        forget()
        for batch in batches:
            texts = _lower(batch["text"])
            keys: list = [[] for _ in texts]
            for a, b in chunked(texts):
                owner, s, counts = shingles(texts[a:b], words)
                if len(s):
                    found = band_keys(samples(owner, s, weights(s, counts, idf.value), bands * rows), bands, rows)
                    for d, row in zip(owner[starts_of(owner)].tolist(), found):
                        keys[a + d] = row
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "bands": keys})

    return docs.select("doc_id", "text", digest("text").alias("digest")).mapInPandas(sign, schema)


# Links


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of texts that share a bucket: every member with the bucket's hub, to begin with.

    The hub has the smallest id after an exclusive or with the bucket's key: another text each time.
    """
    members = nodes.select("node", F.explode("bands").alias("key"))
    hubs = (
        members.groupBy("key")
        .agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("least"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", F.col("least").bitwiseXOR(F.col("key")).alias("hub"))
    )
    met = members.join(hubs, "key").where("node != hub")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def features(docs: DataFrame, idf, words: int = WORDS) -> DataFrame:
    """Per row (node, text): the weighted shingles as 64-bit hashes in order, then 32-bit weights."""

    def describe(batches):
        forget()
        for batch in batches:
            texts, nodes = _lower(batch["text"]), batch["node"]
            for a, b in chunked(texts, CHUNK):
                owner, s, counts = shingles(texts[a:b], words)
                w, blobs = weights(s, counts, idf.value), [b""] * (b - a)
                at = np.r_[starts_of(owner), len(owner)]
                for first, end in zip(at[:-1], at[1:]):
                    blobs[owner[first]] = s[first:end].tobytes() + w[first:end].tobytes()
                yield pd.DataFrame({"node": nodes[a:b], "features": blobs})

    return docs.select("node", "text").mapInPandas(describe, "node long, features binary")


def weighted_jaccard(a: bytes, b: bytes) -> float:
    n, m = len(a) // 12, len(b) // 12
    if not n or not m:
        return float(n == m)
    ha, wa = np.frombuffer(a, _U, n), np.frombuffer(a, np.float32, n, n * 8)
    hb, wb = np.frombuffer(b, _U, m), np.frombuffer(b, np.float32, m, m * 8)
    at = np.minimum(np.searchsorted(hb, ha), m - 1)
    same = hb[at] == ha
    shared = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return shared / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - shared)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component. ``edges`` (a, b) are read often.

    A round groups once and looks twice into the labels of the round before, which are stored: the driver
    has fewer tasks and broadcasts to keep than with joins of what the round makes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b")
        near = near.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("was"), "root")
        own = labels.select("node", F.col("root").alias("was"), "root")
        step = own.unionByName(near).groupBy("node").agg(F.max("was").alias("was"), F.min("root").alias("root"))
        # Follow the root's own root as well, which halves long chains.
        roots = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        step = materialize(
            step.join(roots, "root", "left").select("node", "was", F.coalesce("beyond", "root").alias("root")), "labels"
        )
        labels = step.select("node", "root")
        if step.where("root != was").isEmpty():
            return labels


def links(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar; ``found`` holds the features of their texts."""

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_jaccard(x, y) for x, y in zip(a, b)], dtype="float64")

    return (
        pairs.join(found.select(F.col("node").alias("a"), F.col("features").alias("fa")), "a")
        .join(found.select(F.col("node").alias("b"), F.col("features").alias("fb")), "b")
        .where(similar("fa", "fb") >= similarity)
        .select("a", "b")
    )


def joined(labels: DataFrame, between: DataFrame) -> DataFrame:
    """``labels`` (node, root) after the classes that ``between`` links, pairs (a, b) of roots, have become one."""
    if between.isEmpty():
        return labels
    merged = components(between).select(F.col("node").alias("root"), F.col("root").alias("into"))
    return materialize(labels.join(merged, "root", "left").select("node", F.coalesce("into", "root").alias("root")), "labels")


def mixed_buckets(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, root) of the buckets that hold several classes, with their largest class ``main``, its
    members ``n_main`` and those of all others ``n_other``."""
    members = nodes.join(labels, "node").select("node", "root", F.explode("bands").alias("key"))
    classes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    buckets = classes.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")
    )
    buckets = buckets.where("n > n_main").select("key", "main", "n_main", (F.col("n") - F.col("n_main")).alias("n_other"))
    return members.join(buckets, "key")


def blocks(buckets: DataFrame, block: int) -> DataFrame:
    """(key, kind, i, j, node, root, side): the groups in which the members of mixed buckets are compared.

    Members of the largest class and all others are cut into blocks of about ``block``; each block of the
    others meets every block of both. No two members of the largest class need to be compared.
    """
    main = F.col("root") == F.col("main")
    many, others = (F.ceil(F.col(c) / block).cast("int") for c in ("n_main", "n_other"))
    cut = buckets.withColumn("own", F.pmod(F.xxhash64("node"), F.when(main, many).otherwise(others)).cast("int"))

    def group(kind, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    own = F.col("own")
    with_main = F.transform(F.sequence(F.lit(0), many - 1), lambda i: group("main", i, own))
    among = F.transform(F.sequence(F.lit(0), others - 1), lambda j: group("others", F.least(own, j), F.greatest(own, j)))
    groups = F.when(main, F.transform(F.sequence(F.lit(0), others - 1), lambda j: group("main", own, j)))
    groups = groups.otherwise(F.concat(with_main, among))
    side = F.when(main, F.lit(-1)).otherwise(own)
    return cut.select("key", "node", "root", side.alias("side"), F.explode(groups).alias("g")).select("key", "g.*", "node", "root", "side")


def possible(members: pd.DataFrame, similarity: float) -> np.ndarray:
    """Which two members (rows with ``group`` and ``features``) of one group can be similar.

    The root of a product stands for the lesser weight of a shingle that two texts share: it is not less, and
    matrix products sum it for all pairs at once. Nearly all pairs that pass are similar.
    """
    n, group = len(members), members["group"].to_numpy()
    lengths = np.array([len(f) // 12 for f in members["features"]], np.int64)
    tokens = np.concatenate([np.frombuffer(f, _U, m) for f, m in zip(members["features"], lengths)])
    weight = np.concatenate([np.frombuffer(f, np.float32, m, m * 8) for f, m in zip(members["features"], lengths)])
    owner = np.repeat(np.arange(n), lengths)
    size = np.bincount(owner, weight, n)
    tokens = tokens + mix(group.view(_U))[owner]  # a shingle of another group is another one
    order = np.argsort(tokens, kind="stable")
    tokens, owner, roots = tokens[order], owner[order], np.sqrt(weight[order])
    new = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
    counts = np.diff(np.r_[np.flatnonzero(new), len(tokens)])
    often = np.repeat(counts > 1, counts)  # what only one member has is shared with nobody
    owner, roots = owner[often], roots[often]
    column = np.repeat(np.arange((counts > 1).sum()), counts[counts > 1])
    shared = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4_096):
        a, b = np.searchsorted(column, [first, first + 4_096])
        part = np.zeros((n, min(4_096, int(column[b - 1]) + 1 - first)), np.float32)
        part[owner[a:b], column[a:b] - first] = roots[a:b]
        shared += part @ part.T
    least = similarity / (1 + similarity) * (1 - 1e-4) * (size[:, None] + size[None, :])
    return (shared >= least) & (group[:, None] == group[None, :])


def spanning_links(members: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Pairs of classes, by their roots, that similar members (rows with ``group``, ``apart``, ``node``, ``root``,
    ``side`` and ``features``) of the same group link: a spanning forest, so fewer than there are classes.

    Every two members that can be similar are verified unless links found before join their classes already.
    Long texts are taken in parts of a bounded number of shingles, each two parts together.
    """
    root, side, features = members["root"].to_numpy(), members["side"].to_numpy(), members["features"].tolist()
    apart, label = members["apart"].to_numpy(), np.unique(root, return_inverse=True)[1]
    place = np.cumsum([len(f) // 12 for f in features]) // SHINGLES
    cut = [np.flatnonzero(place == p) for p in np.unique(place)]
    together = cut if len(cut) < 2 else [np.r_[cut[i], cut[j]] for i in range(len(cut)) for j in range(i)]
    links_found = []
    for rows in together:
        if (label[rows] == label[rows[0]]).all():
            continue
        # Where two blocks meet, each of them on its own is another group.
        open_ = ~apart[rows][:, None] | (side[rows][:, None] != side[rows][None, :])
        open_ &= np.triu(possible(members.iloc[rows], similarity), 1)
        while True:
            open_ &= label[rows][:, None] != label[rows][None, :]
            x = np.flatnonzero(open_.any(axis=1))
            if not len(x):
                break
            y = open_[x].argmax(axis=1)
            open_[x, y] = False
            for i, j in zip(rows[x].tolist(), rows[y].tolist()):
                if label[i] != label[j] and weighted_jaccard(features[i], features[j]) >= similarity:
                    links_found.append((min(root[i], root[j]), max(root[i], root[j])))
                    label[label == label[j]] = label[i]
    return links_found


def block_links(nodes: DataFrame, labels: DataFrame, found: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of roots of classes that similar texts of a shared bucket link.

    The texts are verified where they are compared, and a task returns fewer pairs than it holds rows.
    """
    grouped = materialize(blocks(mixed_buckets(nodes, labels), block), "blocks")
    described = grouped.join(found, "node").select(
        F.xxhash64("key", "kind", "i", "j").alias("group"),
        ((F.col("kind") == "main") | (F.col("i") != F.col("j"))).alias("apart"),
        "node", "root", "side", "features",
    )

    def linked(members: pd.DataFrame) -> pa.RecordBatch:
        ends = np.array(spanning_links(members, similarity), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends.T], ["a", "b"])

    def compare(batches):
        """Whole groups at a time, several small ones together."""
        forget()
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if held.num_rows < 2 * block and held.nbytes < 1 << 25:
                continue
            group = held.column("group").to_numpy()
            last = starts_of(group)[-1]
            yield from parts(held.slice(0, last))
            held = held.slice(last)
        if held is not None:
            yield from parts(held)
        held = None
        give_back()

    def parts(table: pa.Table):
        if not table.num_rows:
            return
        members = table.to_pandas()
        first, bounds = 0, [*starts_of(members["group"].to_numpy()).tolist(), len(members)]
        for start, end in zip(bounds, bounds[1:]):
            if end - first > block and start > first:
                yield linked(members.iloc[first:start])
                first = start
        yield linked(members.iloc[first:])

    dealt = described.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _classed(docs: DataFrame, similarity: float, bands: int, rows: int, words: int) -> DataFrame:
    """Per row: doc_id, digest, root (of its class), class_id."""
    spark = docs.sparkSession
    ship(spark)
    idf = spark.sparkContext.broadcast(scaled_idf(*count_shingles(docs, words)))
    give_back()
    signed = materialize(
        signatures(docs, idf, bands, rows, words).withColumn("row", F.monotonically_increasing_id()), "signatures"
    )
    # Rows of one digest have the same bands.
    firsts = F.min("row").alias("node"), F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands")
    texts = materialize(signed.groupBy("digest").agg(*firsts), "texts")
    nodes = texts.select("node", "bands")
    pairs = materialize(candidates(nodes), "pairs")

    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = texts.join(involved, "node").select("node", F.col("digest").alias("_digest"), "first_doc")
    keyed = docs.select("doc_id", "text", digest("text").alias("digest"))
    taken = keyed.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    # A repeated row describes the same text again.
    found = materialize(features(taken, idf, words), "features").dropDuplicates(["node"])

    labels = components(materialize(links(pairs, found, similarity), "links"))
    labels = materialize(involved.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "labels")
    labels = joined(labels, materialize(block_links(nodes, labels, found, similarity), "links"))
    rooted = texts.join(labels, "node", "left").select("digest", "first_doc", F.coalesce("root", "node").alias("root"))
    class_ids = rooted.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    return signed.select("doc_id", "digest").join(rooted.join(class_ids, "root").drop("first_doc"), "digest")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS
) -> DataFrame:
    """Per row: doc_id and class_id, the smallest doc_id of its class (null if all are null)."""
    return _classed(docs, similarity, bands, rows, words).select("doc_id", "class_id")


def keep_one(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS
) -> DataFrame:
    """The rows of ``docs`` with one row per class: that of the smallest doc_id.

    If that id has several texts in the class, the one with the smallest digest stays; of repeated
    rows one stays.
    """
    classed = materialize(_classed(docs, similarity, bands, rows, words), "classes")
    first = classed.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = first.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    least = first.groupBy("root").agg(F.min("digest").alias("digest"))
    kept = first.join(least, ["root", "digest"]).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_kept"), F.col("n").alias("_n")
    )
    rows_of = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), digest("text").alias("_digest"))
    met = rows_of.join(kept, (F.col("_digest") == F.col("_kept")) & F.col("_own").eqNullSafe(F.col("_id")))
    single = met.where("_n = 1").select("_row.*")
    repeated = met.where("_n > 1").dropDuplicates(["_own", "_digest"]).select("_row.*")
    return single.unionByName(repeated)
