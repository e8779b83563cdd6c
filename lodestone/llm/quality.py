"""Quality scores by a sparse ensemble of rules.

Statistics of whole texts feed a few shallow trees; every path from a root is a
rule, a conjunction of comparisons. A lasso logistic regression over the rules
keeps some of them, and these become one Spark expression: scoring reads a text
once and runs no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fold, held_out, words
from lodestone.session import stored

MOST_LABELS = 50_000  # labelled rows the trees and weights are fitted on, about
TREES, DEPTH = 12, 4
LASSO = 0.002
GOOD = 0.7

STATISTICS = (
    "n_words", "word_length", "upper", "marks", "digits", "distinct", "line_words", "repeats", "sentences", "short",
)


def statistics(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc_id, held_out`` and the statistics of the whole text, all finite; 0 where there is nothing."""
    body = fold(text)
    split = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    raw = docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        body.alias("t"),
        words(body).alias("w"),
        F.length(body).alias("c"),
        F.length(F.regexp_replace(body, r"\P{L}+", "")).alias("letters"),
        F.length(F.regexp_replace(body, r"\P{Lu}+", "")).alias("capitals"),
        F.length(F.regexp_replace(body, r"[\p{L}\p{N}\s.,]+", "")).alias("symbols"),
        F.length(F.regexp_replace(body, r"\P{N}+", "")).alias("numbers"),
        F.size(F.array_distinct(split)).alias("kinds"),
        F.regexp_count(body, F.lit(r"\n")).alias("breaks"),
        F.regexp_count(body, F.lit(r"(?<!\S)(\S++)\s+\1(?!\S)")).alias("twice"),
        F.regexp_count(body, F.lit(r"[.?!](?!\S)")).alias("stops"),
        F.regexp_count(body, F.lit(r"(?<!\S)\S{1,2}(?!\S)")).alias("tiny"),
    )

    def per(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)

    return raw.select(
        "doc_id",
        "held_out",
        F.log1p("w").alias("n_words"),
        per("c", "w").alias("word_length"),
        per("capitals", "letters").alias("upper"),
        per("symbols", "c").alias("marks"),
        per("numbers", "c").alias("digits"),
        per("kinds", "w").alias("distinct"),
        (F.col("w") / (F.col("breaks") + 1)).alias("line_words"),
        per("twice", "w").alias("repeats"),
        per("stops", "w").alias("sentences"),
        per("tiny", "w").alias("short"),
    )


@dataclass(frozen=True)
class Rule:
    """Comparisons ``(statistic, at most, bound)`` that all hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(name) <= bound if low else F.col(name) > bound for name, low, bound in self.terms]
        return reduce(Column.__and__, parts)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and an intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """The probability of label 1, over the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, terms: tuple, found: set) -> None:
    """Every node but the root as the rule that leads to it, tightened to one bound per side."""
    if terms:
        tight: dict[tuple[str, bool], float] = {}
        for name, low, bound in terms:
            pick = min if low else max
            tight[name, low] = pick(bound, tight.get((name, low), bound))
        found.add(Rule(tuple(sorted((n, low, b) for (n, low), b in tight.items()))))
    if node.subtreeDepth() > 0:
        name, bound = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        _paths(node.leftChild(), (*terms, (name, True, bound)), found)
        _paths(node.rightChild(), (*terms, (name, False, bound)), found)


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """An ensemble from statistics with a ``label`` of 0 or 1.

    Without labels every score is a half; with labels of one kind the score is the
    share of label 1 among them, a bit drawn to a half.
    """
    counts = {int(r["label"]): r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        return Ensemble(math.log((ones + 0.5) / (zeros + 0.5)))
    near = F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) < int(2**40 * min(1.0, MOST_LABELS / (ones + zeros)))
    sample = stored(labelled.filter(near), "labelled")
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=5, featureSubsetStrategy="onethird"
    ).fit(vectors)
    found: set[Rule] = set()
    for tree in forest.trees:
        _paths(tree._call_java("rootNode"), (), found)
    rules = sorted(found, key=lambda r: r.terms)
    if not rules:
        return Ensemble(0.0 if ones == zeros else math.log(ones / zeros))
    holds = sample.select(
        "label", *[F.when(rule.column(), 1.0).otherwise(0.0).alias(f"r{i}") for i, rule in enumerate(rules)]
    )
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(holds)
    lasso_fit = LogisticRegression(
        elasticNetParam=1.0, regParam=lasso, maxIter=100, standardization=False
    ).fit(matrix.select("label", "features"))
    weights = lasso_fit.coefficients.toArray().tolist()
    kept = tuple((rule, w) for rule, w in zip(rules, weights, strict=True) if w)
    return Ensemble(float(lasso_fit.intercept), kept)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    ensemble: Ensemble | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learned from the labelled rows that are not held out; labels other than 0
    and 1 are ignored, and a document labelled twice counts twice. Null text is
    empty and scored like one. Rows repeated get the same score each.
    """
    stats = stored(statistics(docs, id_col, text), "statistics")
    if ensemble is None:
        marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("label"))
        marks = marks.filter("label in (0, 1)")
        ensemble = fit(stats.filter("not held_out").join(marks, "doc_id"))
    scored = stats.select("doc_id", "held_out", ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
