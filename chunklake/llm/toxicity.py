"""Toxicity by cumulative-link ordinal regression on the words that a text contains.

One weight vector serves all ordered grades: ``P(grade >= k) = sigmoid(x . beta - theta_k)`` with
increasing thresholds. The severity is the expected grade. Features are the distinct words of the
whole text and their beginnings, which inflected and compound forms share; those with the strongest
association to any grade above 0 enter the model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_texts, fresh, materialise, tidy

#: At most so many labelled rows are fitted, those with the least hash of their id; features that enter.
SAMPLE_ROWS, FEATURES = 20_000, 2_048
#: A feature occurs in so many of them at least, its rates differ by so many standard errors; strength of the ridge; severity from which a text is toxic.
LEAST_ROWS, LEAST_Z, RIDGE, TOXIC_FROM = 4, 5.0, 0.05, 0.5
#: Texts whose features are in memory at once.
FEATURE_ROWS = 100
#: Lengths of the beginnings of longer words that are features.
STEMS = (3, 4, 5, 6)

_WORD = re.compile(r"\w+")


def features_of(text: str | None) -> set[str]:
    """Distinct words, lower-cased, and their beginnings, which a ``*`` marks."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in STEMS))


@dataclass
class OrdinalModel:
    """Weights by feature and one threshold for each grade from 1 on."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None) -> float:
        """The sum of the weights of the text's features; beginnings are looked up without marking all."""
        words = set(_WORD.findall((text or "").lower()))
        total = sum(map(self.weights.__getitem__, sorted(words & self.weights.keys())))
        for k, stems in self.stems.items():
            total += sum(map(stems.__getitem__, sorted({w[:k] for w in words if len(w) > k} & stems.keys())))
        return total

    @cached_property
    def stems(self) -> dict[int, dict[str, float]]:
        return {k: {f[:-1]: w for f, w in self.weights.items() if f[-1] == "*" and len(f) == k + 1} for k in STEMS}

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        score = self.score(text)
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - score)))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, features: int, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of the cumulative-link model.

    ``rows`` hold the features present. The thresholds are a first one and positive steps, so that
    their order holds; the climb is Adam's on the full sample, from zero, hence repeatable.
    """
    top = int(grades.max())
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feat = np.fromiter((f for r in rows for f in r), np.int64, len(doc))
    share = np.clip([(grades >= k).mean() for k in range(1, top + 1)], 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    p = np.concatenate((np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = np.arange(len(grades))
    for step in range(1, steps + 1):
        beta, gaps = p[:features], np.exp(np.clip(p[features + 1 :], -20, 20))
        theta = np.cumsum(np.concatenate((p[features : features + 1], gaps)))
        score = np.bincount(doc, beta[feat], len(grades))
        tail = np.column_stack((np.ones(len(grades)), _sigmoid(score[:, None] - theta), np.zeros(len(grades))))
        slope = tail * (1 - tail)
        own = np.maximum(tail[n, grades] - tail[n, grades + 1], 1e-12)
        by_score = (slope[n, grades] - slope[n, grades + 1]) / own
        by_theta = np.zeros_like(theta)
        for k in range(1, top + 1):
            by_theta[k - 1] = -(slope[:, k] / own)[grades == k].sum() + (slope[:, k] / own)[grades == k - 1].sum()
        g = np.concatenate((np.bincount(feat, by_score[doc], features) - ridge * beta, [by_theta.sum()], np.cumsum(by_theta[::-1])[::-1][1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (1 - step / (steps + 1))
    gaps = np.exp(np.clip(p[features + 1 :], -20, 20))
    return p[:features], np.cumsum(np.concatenate((p[features : features + 1], gaps)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third column, a text, to its features; a few rows at a time, as a text has hundreds."""
    for b in batches:
        for k in range(0, b.num_rows, FEATURE_ROWS):
            part = b.slice(k, FEATURE_ROWS)
            found = pa.array([sorted(features_of(t)) for t in part.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["__id", "__grade", "words"])


def severity_grades(rows: list[list[int]], toxic: np.ndarray, marks: set[int]) -> np.ndarray:
    """Grades from yes-or-no labels: 0; 1 for toxic rows; 2 for toxic rows with more marks than the median one."""
    n = np.array([len(marks.intersection(r)) for r in rows])
    cut = np.median(n[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, 1 + (n > cut), 0)


def _gap(n: Column, hit: Column, rows: int, high: int) -> tuple[Column, Column]:
    """How much oftener a feature stands in rows above grade 0, and that in standard errors."""
    if not 0 < high < rows:
        return F.lit(0.0), F.lit(0.0)
    share, gap = n / rows, hit / high - (n - hit) / (rows - high)
    return gap, F.coalesce(F.abs(gap / F.sqrt(share * (1 - share) * (1 / high + 1 / (rows - high)))), F.lit(0.0))


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> OrdinalModel:
    """Fit on ``graded`` (id, ``grade``) joined to ``docs``; no graded row above 0: a model that finds nothing.

    The driver gets at most ``features`` features and, for at most ``sample_rows`` texts, which of
    them they have. Of repeated labels the highest grade holds; null grades, labels without a
    document and documents without a label don't count; rows that share an id are one text with the
    features of all.

    Labels of 0 and 1 alone have no degrees. The toxic rows of each half of the sample are then graded
    by :func:`severity_grades` with the marks that the other half has found: features that stand in its
    toxic rows oftener, by LEAST_Z standard errors. So no row's grade hangs on its own label's marks.
    """
    labels = graded.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("grade").alias("__grade"))
    chosen = F.broadcast(labels.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))
    rows = for_texts(docs).select(id_col, text_col).join(chosen, F.col(id_col) == F.col("__id")).select("__id", F.col("__grade").cast("int").alias("__grade"), text_col)
    rows = materialise(rows.mapInArrow(tidy(_features), f"__id {graded.schema[id_col].dataType.simpleString()}, __grade int, words array<string>"))
    half = (F.xxhash64(F.lit("half"), "__id").bitwiseAND(1)).alias("half")
    sizes = {(r["half"], r["__grade"]): r["count"] for r in rows.groupBy(half, "__grade").count().collect()}
    size = lambda h, least: sum(n for (k, g), n in sizes.items() if k in h and g >= least)
    n, high = size((0, 1), 0), size((0, 1), 1)
    if not high or high == n:
        return OrdinalModel({}, (50.0 if not high else -50.0,))
    counts = rows.select((F.col("__grade") > 0).cast("int").alias("hit"), half, F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.count("*").alias("n"), F.sum("hit").alias("hit"), F.sum("half").alias("n1"), F.sum(F.col("hit") * F.col("half")).alias("hit1"))
    _, z = _gap(F.col("n"), F.col("hit"), n, high)
    marks = []
    for h, (n_h, hit_h) in enumerate(((F.col("n") - F.col("n1"), F.col("hit") - F.col("hit1")), (F.col("n1"), F.col("hit1")))):
        gap_h, z_h = _gap(n_h, hit_h, size((h,), 0), size((h,), 1))
        marks.append(((gap_h > 0) & (z_h >= LEAST_Z)).alias(f"mark{h}"))
    best = counts.withColumn("z", z).where((F.col("n") >= LEAST_ROWS) & (F.col("n") < n) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "word").limit(features).select("word", *marks).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(best)}
    if not vocabulary:
        return OrdinalModel({}, (math.log((n - high) / high),))
    known = F.broadcast(docs.sparkSession.createDataFrame(list(vocabulary.items()), "word string, at int"))
    marked = rows.select("__id", "__grade", F.explode_outer("words").alias("word")).join(known, "word", "left").groupBy("__id", "__grade", half).agg(F.sort_array(F.collect_set("at")).alias("at"))
    sample = marked.orderBy("__id").collect()
    present, grades = [list(r["at"]) for r in sample], np.array([r["__grade"] for r in sample])
    if grades.max() == 1:
        halves = np.array([r["half"] for r in sample])
        for h in (0, 1):
            of = np.nonzero(halves == h)[0]
            other = {i for i, r in enumerate(best) if r[f"mark{1 - h}"]}
            grades[of] = severity_grades([present[i] for i in of], grades[of], other)
    beta, theta = fit_ordinal(present, grades, len(vocabulary))
    return OrdinalModel({w: float(beta[i]) for w, i in vocabulary.items()}, tuple(map(float, theta)))


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", severity: str = "severity", p_toxic: str = "p_toxic") -> DataFrame:
    """``docs`` with the columns ``severity`` (expected grade) and ``p_toxic`` (grade 1 or more).

    Whole texts are read; a null or empty text has no word and gets the model's base rates.
    """

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            severity, p = [], []
            for at in range(0, len(texts), FEATURE_ROWS):  # a few at a time, so that texts are not held twice
                for t in texts.slice(at, FEATURE_ROWS).to_pylist():
                    tails = model.at_least(t)
                    severity.append(sum(tails))
                    p.append(tails[0])
            yield pa.StructArray.from_arrays([pa.array(severity, pa.float64()), pa.array(p, pa.float64())], ["severity", "p_toxic"])

    @F.arrow_udf("severity double, p_toxic double")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(judged)(texts)

    made = fresh(docs, "judged")
    return for_texts(docs).withColumn(made, judge(text_col)).withColumns({severity: F.col(f"{made}.severity"), p_toxic: F.col(f"{made}.p_toxic")}).drop(made)


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", bar: float = TOXIC_FROM) -> DataFrame:
    """The rows whose severity is below the bar, with their columns as they are."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, FEATURE_ROWS):
                part = b.slice(k, FEATURE_ROWS)
                yield part.filter(pa.array([sum(model.at_least(t)) < bar for t in part.column(at).to_pylist()], pa.bool_()))

    return for_texts(docs).mapInArrow(tidy(kept), docs.schema)
