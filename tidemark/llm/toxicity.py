"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are words in lower case and their beginnings of 4, 5 and 6 letters; a feature's value is
the number of different words of the text that have it. Features come from labelled texts: those
that toxic ones hold far more often than clean ones by chance. Clean texts have grade 0; toxic
ones are graded 1 to 3 by thirds of their evidence, the sum of the log odds of their features.
The model shares one weight per feature over all thresholds: the chance of grade ``k`` or more is
the logistic function of (weighted features - threshold k), thresholds ascending. The severity is
the expected grade.

Defined cases: a null text is empty; an empty text has no feature and gets the severity of that;
rows with a null or repeated doc_id are scored each; without toxic or clean labels all severities
are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import new_path
from .labelled import held_out, labelled_texts
from .text import sized

#: Labelled documents of each class that the model may learn from, and features it may have.
PER_CLASS = 6000
MAX_FEATURES = 4096
GRADES = 3
_KEEP_WORDS = 400_000


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n))


def distinct_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of a batch, and the (row, word) pairs of each row's different words."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    letters = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{M}]+", " ")
    lists = pc.split_pattern(letters, " ")
    offsets = np.asarray(lists.offsets)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    pairs = np.unique(row * max(1, len(words)) + coded.indices.to_numpy(zero_copy_only=False))
    return words, pairs // max(1, len(words)), pairs % max(1, len(words))


def _texts_features(column: pa.Array) -> list[Counter]:
    words, rows, which = distinct_words(column)
    found = [Counter() for _ in range(len(column))]
    for r, w in zip(rows.tolist(), which.tolist()):
        if words[w]:
            found[r].update(word_features(words[w]))
    return found


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a feature, summed within the task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in sized(batches):
        for label, found in zip(batch.column("label").to_pylist(),
                                _texts_features(batch.column("text"))):
            counts[label].update(found.keys())
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at:at + 50_000]
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(part, pa.string()),
            "clean": pa.array([counts[0][f] for f in part], pa.int64()),
            "toxic": pa.array([counts[1][f] for f in part], pa.int64())})


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray,
                weights: np.ndarray, width: int, steps: int = 400,
                ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the weighted likelihood of the grades.

    Features are (row, column, value) triples. Thresholds are a first one and the logarithms of
    the steps between them; the optimiser is Adam on the whole sample.
    """
    n, levels = len(grades), GRADES
    theta = np.zeros(width + levels)
    theta[width] = 2.0
    first = second = np.zeros_like(theta)
    share = weights / weights.sum()

    def chance(z):
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, steps + 1):
        cuts = theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1:]))])
        z = np.bincount(rows, values * theta[columns], minlength=n)
        above = chance(z[:, None] - cuts)                       # P(grade >= k), k = 1..
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        p = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-9)
        low, high = slope[i, grades] / p * share, slope[i, grades + 1] / p * share
        by_cut = np.zeros(levels + 2)
        np.add.at(by_cut, grades, low)
        np.subtract.at(by_cut, grades + 1, high)
        by_cut = -by_cut[1:-1]
        grad = np.zeros_like(theta)
        grad[:width] = np.bincount(columns, values * (low - high)[rows], minlength=width)
        grad[:width] -= ridge * theta[:width]
        grad[width] = by_cut.sum()
        tails = np.cumsum(by_cut[::-1])[::-1]
        grad[width + 1:] = tails[1:] * np.exp(theta[width + 1:])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta = theta + 0.1 * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    cuts = theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1:]))])
    return theta[:width], cuts


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic",
                 per_class: int = PER_CLASS) -> tuple[dict[str, float], list[float]]:
    """Weights by feature and thresholds, learnt from at most ``per_class`` labelled documents
    of each class."""
    spark = docs.sparkSession
    texts, _ = labelled_texts(docs, labels, label, per_class)
    path = new_path(spark, "toxic")
    texts.write.parquet(path)
    texts = spark.read.parquet(path)
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}, [float("inf")] * GRADES
    counted = texts.mapInArrow(_count_features, "feature string, clean bigint, toxic bigint") \
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = (F.col("toxic") + 0.5) / (toxic + 1.0), (F.col("clean") + 0.5) / (clean + 1.0)
    odds = F.log(a / b)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = counted.filter(F.col("toxic") >= 2).select(
        "feature", odds.alias("odds"), (odds / error).alias("z")).filter(
        (F.col("odds") > 1.0) & (F.col("z") > 2.0)).orderBy(F.desc("z"), "feature").limit(
        MAX_FEATURES).collect()
    names = {r.feature: i for i, r in enumerate(chosen)}
    log_odds = np.array([r.odds for r in chosen])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            found = [{names[f]: n for f, n in x.items() if f in names}
                     for x in _texts_features(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"),
                "at": pa.array([list(x) for x in found], pa.list_(pa.int32())),
                "n": pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))})

    sample = texts.mapInArrow(
        pick, "doc_id bigint, label int, at array<int>, n array<int>").collect()
    sample.sort(key=lambda r: (r.doc_id, r.at))
    kind = np.array([r.label for r in sample])
    rows = np.repeat(np.arange(len(sample)), [len(r.at) for r in sample])
    columns = np.array([i for r in sample for i in r.at], np.int64)
    values = np.array([v for r in sample for v in r.n], np.float64)
    evidence = np.bincount(rows, values * log_odds[columns], minlength=len(sample))
    cuts = np.quantile(evidence[kind == 1], np.arange(1, GRADES) / GRADES)
    grades = np.where(kind == 1, 1 + np.searchsorted(cuts, evidence, "right"), 0)
    # Both classes weigh the same, as a missed toxic text costs more than its rarity says.
    weights = np.where(kind == 1, 1.0 / toxic, 1.0 / clean)
    theta, thresholds = fit_ordinal(rows, columns, values, grades, weights, len(names))
    return dict(zip(names, theta.tolist())), thresholds.tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic",
                   per_class: int = PER_CLASS) -> DataFrame:
    """For every document ``doc_id``, ``held_out``, ``severity`` (expected grade, 0 to 3),
    ``p_toxic`` (chance of grade 1 or more) and ``toxic`` (1 if that is 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, label, per_class))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        known: dict[str, float] = {"": 0.0}
        for batch in sized(batches):
            if len(known) > _KEEP_WORDS:
                known = {"": 0.0}
            words, rows, which = distinct_words(batch.column("text"))
            for w in words:
                if w not in known:
                    known[w] = sum(weights.get(f, 0.0) for f in word_features(w))
            by_word = np.array([known[w] for w in words] or [0.0])
            z = np.bincount(rows, by_word[which], minlength=batch.num_rows)
            above = 1.0 / (1.0 + np.exp(np.clip(np.array(thresholds) - z[:, None], -700, 700)))
            above[:, np.isinf(thresholds)] = 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0])],
                ["doc_id", "severity", "p_toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        score, "doc_id bigint, severity double, p_toxic double").select(
        "doc_id", held_out().alias("held_out"), "severity", "p_toxic",
        (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))
