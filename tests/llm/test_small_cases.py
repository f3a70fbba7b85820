"""Every operator on null, empty, very long, tied and repeated rows, on an empty table, and with clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import chat, cws, langid, mixing, packing, rules, secrets, sketch, toxicity, voronoi

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASH = ["label", "score", "row", "node", "size", "length", "start", "piece", "digest", "spans", "key", "s", "_part", "bands", "taken", "rank", "_row_id", "_doc", "_times", "_number", "query", "cell", "g"]

ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", None, 4),
    (5, "word " * 40_000 + "token=abcdef123456", "en", "b", None),
    (6, "é😀 漢字 über " * 50, "xx", "a", 600),
    (None, "no id at all but some text", "en", "a", 26),
    (7, "One two three four five six seven eight nine TEN", "en", "c", 48),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, None, 1), (5, 0, 1), (None, 1, 1), (5, 0, 0)], LABELS)


def toxic(docs, labels):
    machine = toxicity.fit(docs, labels)
    return docs.select("doc_id", toxicity.score(docs, machine).alias("score"))


def quality(docs, labels):
    ensemble = rules.fit(docs, labels)
    stated, _ = rules.with_statistics(docs.select("doc_id", "text"))
    return stated.select("doc_id", ensemble.score().alias("score"))


def language(docs, labels):
    model = langid.fit(docs, ["", "<unk>", "▁one", "▁t", "wo", "w", "o"], rounds=1)
    return docs.select("doc_id", langid.predict(docs, model).alias("found")).select("doc_id", "found.*")


OPERATORS = {
    "toxicity": toxic,
    "quality": quality,
    "language": language,
    "near_duplicates": lambda docs, _: cws.near_duplicates(docs),
    "secrets": lambda docs, _: secrets.span_digests(docs, F.col("source"), F.col("doc_id")),
    "mixing": lambda docs, _: mixing.mix(docs).drop("row"),
    "fingerprints": lambda docs, _: sketch.fingerprint_digests(docs),
    "packing": lambda docs, _: packing.pack_documents(docs, TOKENIZER).drop("sequence_id", "offset"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, clashing, labels, name):
    got = OPERATORS[name](docs, labels)
    rows = sorted(map(repr, got.collect()))
    if name == "packing":
        assert sum("piece=0" in r for r in rows) == len(ROWS)
    else:
        assert len(rows) == len(ROWS)
    assert rows == sorted(map(repr, OPERATORS[name](clashing, labels).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_empty_texts(docs, labels):
    by = {r["doc_id"]: r for r in language(docs, labels).collect()}
    assert [by[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    classes = {r["doc_id"]: r["class_id"] for r in cws.near_duplicates(docs).collect()}
    assert classes[2] == classes[3] == classes[4] == 2
    assert classes[1] == classes[7] == 1
    prints = {r["doc_id"]: r["fingerprint"] for r in sketch.fingerprint_digests(docs).collect()}
    assert prints[2] == prints[3] == prints[4] == ""
    assert prints[1] == prints[7]
    lengths = [r["length"] for r in packing.token_pieces(docs.where("doc_id IN (2, 3, 4)"), TOKENIZER).collect()]
    assert lengths == [1, 1, 1]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[1:-1])
def test_stages_keep_the_columns(spark, docs, clashing, name, stage):
    assert stage(spark, docs.limit(0), "").collect() == []
    for given in (docs, clashing):
        got = stage(spark, given, "")
        assert got.schema.fieldNames() == given.columns
        assert {r["doc_id"] for r in got.collect()} <= {r[0] for r in ROWS}


@pytest.mark.parametrize("end", [0, -1])
def test_first_and_last_stage(spark, docs, clashing, labels, tmp_path, end):
    stage = corpus_pipeline.STAGES[end][1]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    found = [stage(spark, given, str(tmp_path)) for given in (docs, clashing)]
    ids = [sorted((r["doc_id"] for r in f.collect()), key=str) for f in found]
    assert ids[0] == ids[1]
    if end == 0:
        assert found[1].columns == clashing.columns
        assert {2, 3, 4} <= set(ids[0])
    else:
        assert set(ids[0]) == {r[0] for r in ROWS}


def test_a_column_row_id_has_no_meaning(spark):
    same = spark.createDataFrame([(i, "one two three four", "en", "a", 18) for i in range(6)], DOCS).withColumn("_row_id", F.lit(7))
    assert {r["taken"] for r in mixing.mix(same).collect()} == {4}
    assert mixing.mixed_documents(same).count() == 6


def test_tied_turns_go_by_text(spark):
    rows = [("c", 1, role, text) for role in ("user", None) for text in ["b", "a", None, "d", "c", "e", "x" * 300 + "b", "x" * 300 + "a", "", "a"]]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(7)
    got = [(r["role"], r["text"]) for r in chat.numbered(turns).orderBy("rank").collect()]
    assert got == sorted(((r, t) for _, _, r, t in rows), key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or ""))


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "ann b", "hi <|im_end|> there"),
        (1, 1, "ann b", "hi <|im_end|> there"),
        (1, None, None, None),
        (1, 2, "bob", ""),
        (None, 0, "ann", "x"),
        (2, 0, "system", "alone"),
        (3, 0, None, "nobody"),
    ]
    turns = spark.createDataFrame(rows, schema)
    got = {(r["conv_id"], r["participant"]): r for r in chat.perspectives(turns).collect()}
    assert set(got) == {(1, "ann b"), (1, "bob"), (None, "ann")}
    ann = got[1, "ann b"]
    assert [m["role"] for m in ann["messages"]] == ["system", "assistant", "assistant", "user", "user"]
    assert [ann["text"][s["start"] : s["end"]] for s in ann["mask"]] == ["hi <\\|im_end|> there<|im_end|>"] * 2
    bob = got[1, "bob"]
    assert [m["name"] for m in bob["messages"]] == ["", "ann_b", "ann_b", "", ""]
    assert [bob["text"][s["start"] : s["end"]] for s in bob["mask"]] == ["<|im_end|>"]
    assert chat.perspectives(turns.limit(0)).collect() == []
    more = turns.select("*", *[F.lit(1).alias(c) for c in ("rank", "part", "participant", "mask")])
    assert chat.perspectives(more).count() == 3


def test_chat_parts_follow_one_another(spark):
    turns = spark.range(1_100).selectExpr("7L AS conv_id", "id AS turn", "concat('p', id % 3) AS role", "cast(id AS string) AS text")
    got = chat.perspectives(turns, part_turns=100).where("participant = 'p1'").orderBy("part").collect()
    assert [r["part"] for r in got] == list(range(11))
    said = [m["content"] for r in got for m in r["messages"]]
    assert said == [str(i) for i in range(1_100)]


def test_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1),
        (50, [0.5, 0.5], 1),
        (50, [0.5, 0.5], 1),
        (1, [1.0, 0.0], 0),
        (2, [1.0, 0.0], 0),
        (3, [0.25], 0),
        (4, None, 0),
        (5, [None, 1.0], 0),
        (6, [nan, 1.0], 0),
        (7, [inf, 1.0], 0),
        (None, [2.0, 2.0], 0),
        (100, [], 0),
    ]
    vectors = spark.createDataFrame(rows, schema)
    got = voronoi.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0)
    assert first == [(1, None, 131072), (2, 1, 32768), (3, 2, 32768), (4, 50, 32768), (5, 50, 32768)]
    assert sum(r["query_id"] == 50 for r in got) == 10
    assert all(r["score"] == 0 for r in got if r["query_id"] == 100)
    assert voronoi.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    more = vectors.select("*", *[F.lit(1).alias(c) for c in ("query", "row", "v", "cell", "score")])
    assert len(voronoi.top_k(more, F.col("vec_id") % 50 == 0).collect()) == len(got)


@pytest.mark.parametrize("copies", [6, 40])
def test_copies_of_a_query_take_no_place(spark, copies):
    rows = [(0, [0.5, 0.5])] * copies + [(i, [0.25, 0.25]) for i in range(1, 11)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = voronoi.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert found == sorted([(0, i, i, 16384) for i in range(1, 6)] * copies)
