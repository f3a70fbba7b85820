from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions.numbers import percentile
from logloom.operators import iforest, textcluster
from logloom.plans import analytics, dashboard
from logloom.sources import tables

FEATURES = (
    "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, total_count BIGINT, error_count BIGINT, "
    "warn_count BIGINT, info_count BIGINT, debug_count BIGINT, error_rate DOUBLE, unique_services BIGINT"
)
BASE = datetime(2025, 6, 15, 10)


def windows(spark, rows):
    data = [
        (BASE + timedelta(minutes=2 * i), BASE + timedelta(minutes=2 * i + 2), *row) for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, FEATURES)


NORMAL = (10, 1, 1, 5, 3, 0.1, 2)
OUTLIER = (1000, 500, 100, 200, 200, 0.5, 15)


@pytest.fixture(scope="module")
def scored(spark):
    return iforest.fit_score_iforest(windows(spark, [NORMAL] * 20 + [OUTLIER]))


def test_too_few_windows(spark):
    few = iforest.fit_score_iforest(windows(spark, [NORMAL] * 4))
    assert few.count() == 0
    assert analytics.anomaly_rows(few).count() == 0


def test_the_outlier_is_found(scored):
    rows = sorted(scored.collect(), key=lambda r: r["score_samples"])
    assert rows[0]["total_count"] == 1000
    assert all(-1 <= r["score_samples"] < 0 for r in rows)
    found = analytics.anomaly_rows(scored, "run").collect()
    assert [r["features"]["total_count"] for r in found] == [1000]
    assert found[0]["score"] < 0 and found[0]["anomaly_score"] == -rows[0]["score_samples"]
    assert found[0]["description"] == (
        "Anomalous window: 1000 events in window, 50.0% error rate, 500 errors, 15 services"
    )


def random_windows(spark, n):
    rng = np.random.default_rng(7)
    rows = [
        (int(t), int(e), int(w), 0, 0, round(float(e / t), 4), int(s))
        for t, e, w, s in zip(rng.integers(50, 90, n), rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 9, n))
    ]
    return windows(spark, rows)


def test_scores_depend_on_the_seed_only(spark):
    frame = random_windows(spark, 1500)

    def scores(df, **options):
        return {r["window_start"]: r["score_samples"] for r in iforest.fit_score_iforest(df, **options).collect()}

    want = scores(frame.coalesce(1))
    assert scores(frame.repartition(5)) == want
    assert scores(frame, seed=1) != want


def test_share_of_flagged_windows(spark):
    result = iforest.fit_score_iforest(random_windows(spark, 1500))
    flagged = iforest.flag_anomalies(result)
    assert 0 < flagged.count() <= 150
    cut = np.percentile([r["score_samples"] for r in result.collect()], 10)
    assert percentile(result, "score_samples", 0.1) == pytest.approx(cut, rel=1e-12)


def test_forest_is_bounded(spark):
    nodes = iforest.fit_forest(random_windows(spark, 1500), 1500)
    sizes = {r["tree"]: r["count"] for r in nodes.groupBy("tree").count().collect()}
    assert len(sizes) == 100 and max(sizes.values()) <= 511


def test_path_lengths():
    assert [float(iforest.mean_path(n)) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    harmonic = sum(1 / i for i in range(1, 256))
    assert float(iforest.mean_path(256)) == pytest.approx(2 * harmonic - 2 * 255 / 256, abs=0.01)


def test_descriptions(spark):
    rows = [(100, 10, 5, 0, 0, 0.1, 3), (50, 0, 0, 0, 0, 0.0, 1), (16, 1, 0, 0, 0, 0.0625, 1), (2000, 1, 0, 0, 0, 0.0005, 1)]
    text = iforest.describe_window(F.col("total_count"), F.col("error_rate"), F.col("error_count"), F.col("unique_services"))
    got = [r[0] for r in windows(spark, rows).orderBy("window_start").select(text).collect()]
    assert got == [
        "Anomalous window: 100 events in window, 10.0% error rate, 10 errors, 3 services",
        "Anomalous window: 50 events in window, 1 services",
        f"Anomalous window: 16 events in window, {6.25:.1f}% error rate, 1 errors, 1 services",
        f"Anomalous window: 2000 events in window, {0.0005 * 100:.1f}% error rate, 1 errors, 1 services",
    ]


def messages(spark, texts):
    return spark.createDataFrame(
        [(t, BASE + timedelta(seconds=i)) for i, t in enumerate(texts)], "message STRING, timestamp TIMESTAMP_NTZ"
    )


TEXTS = (
    ["Database connection lost on primary"] * 12
    + [f"Payment refused for order {i}" for i in range(12)]
    + ["Disk quota exceeded: volume data", "Disk quota exceeded: volume logs"] * 6
)


def brute_tfidf(texts, stop):
    import re

    docs = [[t for t in re.findall(r"\b\w\w+\b", x.lower()) if t not in stop] for x in texts]
    df = {}
    for doc in docs:
        for t in set(doc):
            df[t] = df.get(t, 0) + 1
    vocab = sorted(t for t in df if df[t] <= 0.95 * len(docs))
    idf = {t: np.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for text, doc in zip(texts, docs):
        v = np.array([doc.count(t) * idf[t] for t in vocab])
        out[text] = v / (np.linalg.norm(v) or 1)
    return vocab, out


def test_weights_match_brute_force(spark):
    from logloom.functions.text import english_stop_words

    terms, want = brute_tfidf(TEXTS, set(english_stop_words()))
    tokenized, vocab, k = textcluster.prepare(messages(spark, TEXTS))
    assert tokenized.agg(F.sum("copies")).first()[0] == len(TEXTS) and k == len(TEXTS) // 5
    assert sorted(v["term"] for v in vocab) == terms
    place = {v["term"]: i for i, v in enumerate(vocab)}
    for row in textcluster.tfidf_vectors(tokenized, vocab).collect():
        got = row["features"].toArray()
        assert np.allclose([got[place[t]] for t in terms], want[row["message"]])
    long = textcluster.tfidf_weights(tokenized, textcluster.vocabulary(tokenized)).collect()
    assert all(np.isclose(want[r["message"]][terms.index(r["term"])], r["weight"]) for r in long)


def test_no_message_takes_part_in_a_shuffle(spark):
    tokenized, _, _ = textcluster.prepare(messages(spark, TEXTS))
    found = textcluster.tfidf_weights(tokenized, textcluster.vocabulary(tokenized))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert textcluster.tfidf_weights(tokenized, textcluster.vocabulary(tokenized.limit(0))).count() == 0


def test_clusters(spark):
    assigned, vocab = textcluster.assign_clusters(messages(spark, TEXTS), restarts=3)
    rows = textcluster.cluster_table(assigned, vocab).collect()
    label = {r["message"]: r["label"] for r in assigned.collect()}
    assert sum(r["count"] for r in rows) == len(TEXTS)
    assert len({r["label"] for r in rows}) == len(rows) <= max(2, len(TEXTS) // 5)
    known = {v["term"] for v in vocab}
    for r in rows:
        assert label[r["example_message"]] == r["label"]
        assert r["first_seen"] <= r["last_seen"]
        words = r["keywords"].split(", ")
        assert 1 <= len(words) <= 5 and set(words) <= known
    assert label["Disk quota exceeded: volume data"] != label["Database connection lost on primary"]


def test_representative_and_keywords_match_brute_force(spark):
    tokenized, vocab, _ = textcluster.prepare(messages(spark, TEXTS))
    vectors = textcluster.tfidf_vectors(tokenized, vocab).withColumn("label", F.length("message") % 2)
    points = {r["message"]: (r["label"], r["copies"], r["features"].toArray()) for r in vectors.collect()}
    for row in textcluster.cluster_table(vectors, [*vocab]).collect():
        members = {m: (n, v) for m, (label, n, v) in points.items() if label == row["label"]}
        center = sum(n * v for n, v in members.values()) / sum(n for n, _ in members.values())
        nearest = min((round(float(np.linalg.norm(v - center)), 9), m) for m, (_, v) in members.items())
        assert row["example_message"] == nearest[1]
        best = sorted((-round(w, 9), v["term"]) for w, v in zip(center, vocab) if w > 0)[:5]
        assert row["keywords"] == ", ".join(t for _, t in best)


def test_starts_share_their_scans(spark, monkeypatch):
    from logloom.operators import kmeans

    tokenized, vocab, k = textcluster.prepare(messages(spark, TEXTS))
    vectors = textcluster.tfidf_vectors(tokenized, vocab)
    passes, real = [], kmeans._pass
    monkeypatch.setattr(kmeans, "_pass", lambda p, c, t: passes.append(c.shape) or real(p, c, t))
    found = kmeans.fit(vectors, len(vocab), k, 6, 42, 50)
    assert found.shape == (k, len(vocab)) and passes[1][0] == 6 and len(passes) <= 51
    assert [n for n, _, _ in passes[1:]] == sorted((n for n, _, _ in passes[1:]), reverse=True)
    assert np.allclose(found, kmeans.fit(vectors.repartition(3), len(vocab), k, 6, 42, 50))
    monkeypatch.setattr(kmeans, "DIRECT", 0)
    assert np.allclose(found, kmeans.fit(vectors, len(vocab), k, 6, 42, 50))


def test_centres_are_as_good_as_those_of_many_plain_starts(spark):
    from logloom.operators import kmeans

    draw = np.random.default_rng(4)
    topics = [[f"t{c}_{i}" for i in range(8)] for c in range(5)]
    texts = [" ".join([*draw.choice(topics[i % 5], 4), f"noise{draw.integers(40)}"]) for i in range(150)]
    tokenized, vocab, _ = textcluster.prepare(messages(spark, texts))
    vectors = textcluster.tfidf_vectors(tokenized, vocab)
    rows = [(r["copies"], r["features"].toArray()) for r in vectors.collect()]
    x, w = np.array([v for _, v in rows]), np.array([n for n, _ in rows], float)

    def cost(centers):
        return w @ ((x[:, None] - centers[None]) ** 2).sum(2).min(1)

    best = np.inf
    for s in range(30):
        centers = x[np.random.default_rng(s).choice(len(x), 5, replace=False)]
        for _ in range(40):
            label = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
            centers = np.array([w[label == c] @ x[label == c] / w[label == c].sum() if (label == c).any() else centers[c] for c in range(5)])
        best = min(best, cost(centers))
    assert cost(kmeans.fit(vectors, len(vocab), 5, 10, 42, 100)) <= best * 1.02


def test_more_centres_than_points(spark):
    from logloom.operators import kmeans

    tokenized, vocab, _ = textcluster.prepare(messages(spark, ["alpha beta", "gamma delta", "gamma delta", "the of"]))
    vectors = textcluster.tfidf_vectors(tokenized, vocab)
    found = vectors.withColumn("label", kmeans.nearest(F.col("features"), kmeans.fit(vectors, len(vocab), 6, 3, 42, 20)))
    assert found.select("label").distinct().count() == 3


def test_nothing_to_cluster(spark):
    assert textcluster.assign_clusters(messages(spark, ["alone"])) is None
    assert textcluster.assign_clusters(messages(spark, ["same words", "same words"])) is None
    assert textcluster.assign_clusters(messages(spark, ["the of", "and a", "7"])) is None


@pytest.mark.parametrize("n, k", [(2, 2), (9, 2), (14, 2), (15, 3), (99, 19), (100, 20), (10**9, 20)])
def test_cluster_count(spark, n, k):
    assert spark.range(1).select(textcluster.choose_k(n)).first()[0] == k


def test_long_messages_are_used_and_shown_whole(spark):
    long = "word " * 3000 + "ending"
    tokenized, vocab, _ = textcluster.prepare(messages(spark, [long, "other text", "third thing"]))
    assert "ending" in {v["term"] for v in vocab}
    vectors = textcluster.tfidf_vectors(tokenized, vocab).withColumn("label", F.lit(0))
    shown = textcluster.cluster_table(vectors.where(F.length("message") > 100), vocab).first()
    assert shown["example_message"] == long


def test_scores_on_the_dashboard(spark):
    df = spark.createDataFrame(
        [(BASE, BASE, s) for s in (0.0, 0.1, 0.4, 0.45, 0.7, 0.705, 1.0)],
        "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, anomaly_score DOUBLE",
    )
    rows = {r["score"]: (r["band"], r["score_pct"], r["table_band"]) for r in dashboard.anomaly_timeline(df).collect()}
    assert rows[0.4] == ("normal", 40, "normal") and rows[0.45] == ("moderate", 45, "moderate")
    assert rows[0.7] == ("moderate", 70, "moderate") and rows[0.705] == ("high", 71, "high")
    from logloom.operators.windows import score_histogram

    bins = [r["windows"] for r in score_histogram(df).orderBy("bin").collect()]
    assert bins == [1, 1, 0, 0, 2, 0, 0, 2, 0, 1]
    assert [r["windows"] for r in score_histogram(df.limit(0)).collect()] == [0] * 10


def test_keyword_list(spark):
    df = spark.createDataFrame([("a, b,c",), ("",), (None,)], "k STRING")
    assert [r[0] for r in df.select(dashboard.keyword_list(F.col("k"))).collect()] == [["a", "b", "c"], [], []]


def run_entries(spark):
    rows = []
    for i in range(60):
        error = i % 3 == 0
        rows.append((BASE + timedelta(minutes=i), "ERROR" if error else "INFO", f"svc-{i % 4}", f"{TEXTS[i % 36]}", "parsed"))
    return spark.createDataFrame(
        rows, "timestamp TIMESTAMP_NTZ, level STRING, service STRING, message STRING, parse_status STRING"
    )


def test_run(spark, tmp_path):
    root, end = str(tmp_path), BASE + timedelta(hours=2)
    first = analytics.run_analytics(spark, root, run_entries(spark), "test", end=end).first()
    assert first["status"] == "completed" and first["error"] is None
    assert first["duration_seconds"] > 0
    found, clusters = tables.load(spark, root, "anomalies"), tables.load(spark, root, "error_clusters")
    assert found.count() == first["anomalies_detected"] and clusters.count() == first["clusters_created"] > 0
    assert {r["pipeline_run_id"] for r in clusters.collect()} == {first["id"]}

    # Too little in range: what is there stays.
    second = analytics.run_analytics(spark, root, run_entries(spark), "test", end=BASE - timedelta(days=1)).first()
    assert (second["status"], second["anomalies_detected"], second["clusters_created"]) == ("completed", 0, 0)
    assert tables.load(spark, root, "error_clusters").count() == first["clusters_created"]

    # The same range again: replaced, not doubled.
    third = analytics.run_analytics(spark, root, run_entries(spark), "test", end=end).first()
    ids = {r["pipeline_run_id"] for r in tables.load(spark, root, "anomalies").collect()}
    assert ids == ({third["id"]} if third["anomalies_detected"] else set())
    runs = tables.load(spark, root, "pipeline_runs")
    assert runs.count() == 3 and {r["status"] for r in runs.collect()} == {"completed"}


def test_a_failing_run_is_recorded(spark, tmp_path):
    broken = run_entries(spark).withColumn("level", F.raise_error(F.lit("boom " * 1000)).cast("string"))
    row = analytics.run_analytics(spark, str(tmp_path), broken, "test", end=BASE + timedelta(hours=2)).first()
    assert row["status"] == "failed" and ("boom " * 1000).strip() in row["error"]
    assert tables.load(spark, str(tmp_path), "pipeline_runs").first()["status"] == "failed"


def test_replacing_a_range_keeps_what_reaches_out_of_it(spark):
    at = lambda m: BASE + timedelta(minutes=m)
    frame = lambda rows: spark.createDataFrame(rows, "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, n INT")
    old = frame([(at(0), at(2), 0), (at(2), at(4), 1), (at(4), at(8), 2), (at(8), at(10), 3)])
    kept = tables.replace_anomalies(old, frame([(at(2), at(4), 9)]), at(2), at(6))
    assert sorted(r["n"] for r in kept.collect()) == [0, 2, 3, 9]


def test_anomaly_windows_restrict_the_charts(spark):
    features = windows(spark, [NORMAL, OUTLIER, NORMAL])
    only = features.where("total_count = 1000")
    assert [tuple(r)[1:] for r in dashboard.rate_and_volume(features, only).collect()] == [(50.0, 1000)]
    assert [tuple(r)[1:] for r in dashboard.log_composition(features, only).collect()] == [(500, 100, 200, 200)]
    assert dashboard.service_activity(features).count() == 3


def test_tasks_do_not_need_the_package_installed(tmp_path):
    """The driver may find the package by a path the workers do not have."""
    import subprocess
    import sys
    from pathlib import Path

    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from logloom.session import build_session
from logloom.operators import iforest
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = spark.range(30).selectExpr(
    "timestamp_ntz'2025-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS window_start", "id AS total_count",
    "0L AS error_count", "0D AS error_rate", "1L AS unique_services", "0L AS warn_count")
print("scored", iforest.fit_score_iforest(rows).count())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "scored 30" in done.stdout, done.stderr[-2000:]
