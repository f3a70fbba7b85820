"""What the driver holds and plans for the stages of the pipeline stays small."""

import tracemalloc

import numpy as np
import pytest

from logloom.llm import cws, toxicity


def _peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture
def stored_plans(monkeypatch):
    """The optimized plans of what ``cws`` stores, by name."""
    plans, store = {}, cws.materialize

    def recorded(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(cws, "materialize", recorded)
    return plans


def test_frequencies_are_scaled_in_parts():
    cells = np.random.default_rng(3).integers(0, 300, 2 * cws.CELLS)
    want = []
    for row in (cells[: cws.CELLS], cells[cws.CELLS :]):
        frequency = np.clip(row - (row.sum() - row) / (cws.CELLS - 1), 1, 50_000)
        want.append(1 + np.log(50_000 / frequency) / np.log(50_000))
    assert np.array_equal(cws.scaled_idf(50_000, cells), np.concatenate(want).astype(np.float32))
    assert _peak_mb(lambda: cws.scaled_idf(50_000, cells)) < 20


def test_training_holds_one_copy_of_its_matrix():
    draw = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, n)) for n in draw.integers(4, 20, 13_000)]
    negatives = {w: int(n) for w, n in zip(words[300:], draw.integers(1, 50, 12_700))}
    toxicity.train(words[:300], negatives)  # tables that are kept
    assert _peak_mb(lambda: toxicity.train(words[:300], negatives)) < 60


def test_a_round_of_components_joins_twice(spark, stored_plans):
    edges = [(0, i) for i in range(1, 9)] + [(i, i + 1) for i in range(20, 36)] + [(8, 50), (50, 51)]
    found = cws.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {
        **{i: 0 for i in (*range(9), 50, 51)}, **{i: 20 for i in range(20, 37)}
    }
    rounds = [p for p in stored_plans["labels"] if "Join" in p]
    assert rounds and all(p.count("Join") == 2 for p in rounds)


def test_texts_are_stored_with_their_bands(spark, stored_plans):
    base = [f"w{i} is here" for i in range(30)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1]), "something else", " ", None, "", "something else"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in cws.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 3}
    assert stored_plans["pairs"][0].count("Join") == 1  # members with hubs, both from the stored texts
