import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions.numbers import percentile, round_even, value_at_rank
from logloom.functions.text import english_stop_words, tokens


def test_rounding_follows_the_exact_binary_value(spark):
    values = [1 / 32, 0.00005, 2 / 3, 1 / 3, 0.0, 1.0, 3 / 32, 0.12345, 12345.67895]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r[0] for r in df.select(round_even(F.col("v"), 4)).collect()]
    assert got == [round(v, 4) for v in values]


def test_rates_of_all_small_counts(spark):
    df = spark.range(1, 301).selectExpr("id AS n", "explode(sequence(0L, id)) AS k")
    rows = df.select("k", "n", round_even(F.col("k") / F.col("n"), 4), round_even(F.col("k") / (F.col("n") * 64), 1))
    assert all(r[2] == round(r["k"] / r["n"], 4) and r[3] == round(r["k"] / (r["n"] * 64), 1) for r in rows.collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_percentile_is_numpys(spark, values, share):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE").repartition(3)
    assert percentile(df, "v", share) == pytest.approx(np.percentile(values, share * 100), rel=1e-12, abs=1e-9)


def test_rank_among_hot_and_extreme_values(spark):
    values = [2**63 - 1, -(2**63), 0, 0, 0, 0, 1, 2**62, 2**62 + 1]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    ordered = sorted(values)
    for rank, value in enumerate(ordered):
        assert value_at_rank(df, "v", rank, slots=4) == (value, ordered.index(value))
    with pytest.raises(ValueError):
        value_at_rank(df, "v", len(values))


def test_tokens(spark):
    df = spark.createDataFrame([("The Café's user_1 can't open /var/log x 7 42 ÜBER",)], "t STRING")
    row = df.select(tokens(F.col("t"), []).alias("all"), tokens(F.col("t")).alias("kept")).first()
    assert row["all"] == ["the", "café", "user_1", "can", "open", "var", "log", "42", "über"]
    assert row["kept"] == ["café", "user_1", "open", "var", "log", "42", "über"]
    assert "for" in english_stop_words()


@pytest.mark.parametrize("rank", range(9))
def test_ranks_among_infinite_values(spark, rank):
    inf, nan = float("inf"), float("nan")
    values = [-inf, -1e308, 0.5, 0.5, 1e308, inf, inf, nan, nan]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v DOUBLE").repartition(3)
    value, before = value_at_rank(df, "v", rank)
    same = [i for i, v in enumerate(values) if v == value or (math.isnan(v) and math.isnan(value))]
    assert rank in same and before == same[0]


def test_percentile_without_values(spark):
    assert percentile(spark.createDataFrame([(None,)], "v DOUBLE"), "v", 0.5) is None
