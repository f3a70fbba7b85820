"""Quality of texts by a sparse ensemble of rules (RuleFit; Friedman and Popescu, 2008).

Every text gets a few native statistics. A random forest learned on labelled texts supplies rules: each
path from a root is a conjunction of bounds on statistics. A logistic regression with lasso penalty
picks and weighs them. The kept rules are compiled into one Spark column expression, so that scoring is
a projection without Python.

Null texts count as empty; empty and blank texts have zero for every statistic and are scored like any
other. Without labels of both kinds the score is the share of good ones, 0.5 if there is none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import materialize

from .common import labelled_ids

PER_CLASS = 8_000  # labelled documents to learn from, each of good and bad
TREES, DEPTH = 20, 3
PENALTY = 0.002

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Adds one column per statistic; their names start with ``_q``."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = (
        docs.withColumn("_qt", t)
        .withColumn("_qw", F.filter(F.split("_qt", r"\s+"), lambda w: w != ""))
        .withColumn("_ql", F.filter(F.split("_qt", r"\n"), lambda line: line != ""))
        .withColumn("_qn", F.size("_qw"))
    )
    n, chars = F.col("_qn"), F.length("_qt")
    again = F.aggregate(
        F.zip_with("_qw", F.expr("slice(_qw, 2, greatest(_qn, 1))"), lambda a, b: (a == b).cast("int")),
        F.lit(0),
        lambda total, same: total + F.coalesce(same, F.lit(0)),
    )
    found = {
        "_q_words": F.log1p(n.cast("double")),
        "_q_word_length": _share(F.aggregate("_qw", F.lit(0), lambda total, w: total + F.length(w)), n),
        "_q_distinct": _share(F.size(F.array_distinct("_qw")), n),
        "_q_again": _share(again, n),
        "_q_symbols": _share(F.regexp_count("_qt", F.lit(r"[^\p{L}\p{N}\s]")), chars),
        "_q_symbol_runs": _share(F.regexp_count("_qt", F.lit(r"[^\p{L}\p{N}\s]{2,}+")), n),
        "_q_lone_symbols": _share(F.size(F.filter("_qw", lambda w: (F.length(w) == 1) & ~F.lower(w).between("0", "9") & (F.lower(w) == F.upper(w)))), n),
        "_q_upper": _share(F.regexp_count("_qt", F.lit(r"\p{Lu}")), chars),
        "_q_digits": _share(F.regexp_count("_qt", F.lit(r"\p{Nd}")), chars),
        "_q_line_words": _share(n, F.size("_ql")),
        "_q_line_distinct": _share(F.size(F.array_distinct("_ql")), F.size("_ql")),
    }
    kept = [F.col(c) for c in docs.columns]
    return base.select(*kept, *[c.cast("double").alias(name) for name, c in found.items()]), list(found)


def paths(tree, names: list[str]) -> list[Rule]:
    """Every path from the root of a Spark ML tree to a node, as a conjunction of bounds."""

    def below(node, path: Rule) -> list[Rule]:
        found = [path] if path else []
        if node.numDescendants() > 0:
            split = node.split()
            name, bound = names[split.featureIndex()], float(split.threshold())
            found += below(node.leftChild(), (*path, (name, "<=", bound)))
            found += below(node.rightChild(), (*path, (name, ">", bound)))
        return found

    return below(tree._call_java("rootNode"), ())


def condition(rule: Rule) -> Column:
    tests = (F.col(name) <= bound if sign == "<=" else F.col(name) > bound for name, sign, bound in rule)
    return reduce(lambda a, b: a & b, tests)


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[float, Rule]]

    def score(self) -> Column:
        """Over the columns that ``with_statistics`` adds."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS,
    trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY,
) -> Ensemble:
    """Learns from about ``per_class`` labelled documents of each class outside the held-out fold."""
    ids = labelled_ids(labels, "quality", folds, held_out, per_class)
    labelled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text")
    stated, names = with_statistics(labelled)
    stated = materialize(stated.drop("text"), "statistics")
    counts = {r["label"]: r["n"] for r in stated.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        share = (good + 0.5) / (good + bad + 1)
        return Ensemble(math.log(share / (1 - share)), [])
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(stated)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, seed=6
    ).fit(rows)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree, names)))
    if not rules:
        return Ensemble(math.log(good / bad), [])
    # Few combinations of rules occur, so the many passes of the fit go over these with their counts.
    fired = stated.select("label", F.array(*[condition(r).cast("double") for r in rules]).alias("fired"))
    fired = materialize(fired.groupBy("label", "fired").agg(F.count("*").cast("double").alias("n")), "fired")
    lasso = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="n", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=100
    ).fit(fired.select("label", "n", array_to_vector("fired").alias("x")).coalesce(1))
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), [(w, r) for w, r in zip(weights, rules) if abs(w) > 1e-9])
