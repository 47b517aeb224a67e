"""Quality rules: counts of a text, and a calibrated logistic regression on hashed n-grams.

Base rules count words, repeated windows and lines and reject what is short or repetitive. What
passes them is judged by a logistic regression over words, pairs of words, and triples and
quadruples of bytes (character n-grams of the UTF-8 text), each kind hashed to ``2 ** BITS``
columns. A column's value is its share of the text's n-grams of that kind, so a score is a sum of
looked-up weights and long texts cost no sort. Weights come from labelled rows; a third of these is
left out of the fit and turns scores into probabilities (a logistic curve in two parameters, with
the labels' own class sizes). Documents score in Arrow batches against one fixed threshold.

Words are ``[^\\x20\\x09-\\x0D]+``. Words and windows are compared by 64-bit hashes, texts by rows.
Defined cases: a null text is empty; an empty text has no words and fails the base rules; rows with
a null or repeated doc_id are judged each; without labels of both classes the regression keeps
everything, or nothing if all labels are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import labelled_texts
from .text import mix64, sized, utf8, word_hashes

#: Labelled documents of each class that the model may learn from.
PER_CLASS = 1500
BITS = 16
THRESHOLD = 0.5
#: Base rules: fewest words, and the largest share of words in repeated windows in percent.
MIN_WORDS, MAX_REPEATED = 50, 50
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = " \t\n\x0b\x0c\r"
_KINDS = 4
_SCALE = 30.0


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Words, their code points, symbols, words in repeated windows of three, repeated lines."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=rows)

    letter = ((data & 0xC0) != 0x80) & ~np.isin(data, np.frombuffer(_SPACES.encode(), np.uint8))
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    words, first = word_hashes(column, fold=False)
    repeated = np.zeros(rows, np.int64)
    if len(words) > 2:
        of = np.repeat(np.arange(rows), np.diff(first))
        with np.errstate(over="ignore"):
            window = mix64(mix64(words[:-2] * _ODD + words[1:-1]) * _ODD + words[2:])
            window = mix64(window + of[:-2].astype(np.uint64) * _ODD)
        inside = np.flatnonzero(of[:-2] == of[2:])
        _, which, count = np.unique(window[inside], return_inverse=True, return_counts=True)
        start = inside[count[which] > 1]
        hit = np.zeros(len(words), bool)
        for k in range(3):
            hit[start + k] = True
        repeated = np.bincount(of[hit], minlength=rows)
    lines = np.zeros(rows, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            full = [line for line in text.split("\n") if line.strip(_SPACES)]
            lines[i] = len(full) - len(set(full))
    return {"n_words": np.diff(first), "word_chars": per_row(letter), "n_symbols": per_row(symbol),
            "n_dup_lines": lines, "n_repeat_words": repeated}


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram the row and the column of every occurrence."""
    shift = np.uint64(64 - BITS)
    words, first = word_hashes(column, fold=False)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield of, (words >> shift).astype(np.int64)
    same = of[1:] == of[:-1]
    with np.errstate(over="ignore"):
        pair = mix64(words[:-1] * _ODD + words[1:])
    yield of[1:][same], (pair[same] >> shift).astype(np.int64) + (1 << BITS)
    data, offsets = utf8(column)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for kind, n in ((2, 3), (3, 4)):
        size = max(0, len(data) - n + 1)
        code = np.zeros(size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                code <<= np.uint64(8)
                code |= data[k:k + size]
            code *= _ODD
        same = row[:size] == row[n - 1:n - 1 + size]
        yield row[:size][same], (code[same] >> shift).astype(np.int64) + (kind << BITS)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.bias)
        for row, at in grams(column):
            total = np.bincount(row, self.weights[at], minlength=len(column))
            z += _SCALE * total / np.maximum(np.bincount(row, minlength=len(column)), 1)
        return _chance(self.slope * z + self.shift)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _constant(value: float) -> Model:
    return Model(np.zeros(_KINDS << BITS, np.float32), 0.0, 0.0, value)


def fit_logistic(starts: np.ndarray, at: np.ndarray, value: np.ndarray, labels: np.ndarray,
                 share: np.ndarray, steps: int = 60, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the weighted logistic loss of sparse rows, by Adam on all of
    them. Row ``i`` has the entries from ``starts[i]`` to ``starts[i + 1]``."""
    width = _KINDS << BITS
    count = np.diff(starts)
    theta, first, second = (np.zeros(width + 1) for _ in range(3))
    for step in range(1, steps + 1):
        sums = np.concatenate([[0.0], np.cumsum(value * theta[at])])
        z = sums[starts[1:]] - sums[starts[:-1]] + theta[width]
        error = (_chance(z) - labels) * share
        grad = np.append(np.bincount(at, value * np.repeat(error, count), minlength=width),
                         error.sum())
        grad[:width] += ridge * theta[:width]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta -= 0.05 * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return theta[:width], float(theta[width])


def fit_curve(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to chances of label 1, by Newton's method.
    Targets lie a little inside 0 and 1, so that classes which scores part stay finite."""
    ones, noughts = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (noughts + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.array([0.1, 0.0])

    def loss(b):
        t = x @ b
        return float((weights * (np.logaddexp(0, t) - target * t)).sum())

    for _ in range(50):
        p = _chance(x @ beta)
        grad = x.T @ (weights * (p - target))
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(curve, grad), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns and values of each text's n-grams."""
    for batch in sized(batches):
        rows, ats, values = [], [], []
        for row, at in grams(batch.column("text")):
            total = np.bincount(row, minlength=batch.num_rows)
            key, count = np.unique(row.astype(np.int64) << 32 | at, return_counts=True)
            rows.append(key >> 32)
            ats.append((key & 0xFFFFFFFF).astype(np.int32))
            values.append((_SCALE * count / total[key >> 32]).astype(np.float32))
        order = np.argsort(np.concatenate(rows), kind="stable")
        ends = np.searchsorted(np.concatenate(rows)[order], np.arange(batch.num_rows + 1))
        ends = pa.array(ends.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ats)[order])),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)[order]))],
            ["doc_id", "label", "at", "value"])


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality",
              per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class."""
    texts, sizes = labelled_texts(docs, labels, label, per_class)
    sample = texts.mapInArrow(
        _sparse, "doc_id bigint, label int, at array<int>, value array<float>").withColumn(
        "fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).toArrow()
    sample = sample.sort_by("doc_id").combine_chunks()
    kinds = sample.column("label").to_numpy()
    if len(set(kinds.tolist())) < 2:
        return _constant(-50.0 if len(kinds) and not kinds.any() else 50.0)
    curve = sample.column("fold").to_numpy() == 3
    if len(set(kinds[~curve].tolist())) < 2 or len(set(kinds[curve].tolist())) < 2:
        curve = np.zeros(len(kinds), bool)  # too few labels to leave some out
    lists = sample.column("at").combine_chunks()
    count = lists.value_lengths().to_numpy()
    at = lists.flatten().to_numpy()
    value = sample.column("value").combine_chunks().flatten().to_numpy()
    learn = np.repeat(~curve, count)
    starts = np.concatenate([[0], np.cumsum(count[~curve])])
    y = kinds[~curve].astype(np.float64)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    weights, bias = fit_logistic(starts, at[learn], value[learn], y, share)
    left = curve if curve.any() else ~curve
    rows = np.repeat(np.arange(len(kinds)), count)
    z = (np.bincount(rows, value * weights[at], minlength=len(kinds)) + bias)[left]
    known = kinds[left]
    as_labelled = np.where(known == 1, sizes.get(1, 0) / max((known == 1).sum(), 1),
                           sizes.get(0, 0) / max((known == 0).sum(), 1))
    as_labelled *= len(known) / as_labelled.sum()
    slope, shift = fit_curve(z, known, as_labelled)
    return Model(weights.astype(np.float32), bias, slope, shift)


def judge_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                  threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """For every document ``doc_id``, the counts ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines`` and ``n_repeat_words``, ``base_failed``, ``probability`` (of label 1) and
    ``kept`` (base rules passed and ``threshold`` reached)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_rules(docs, labels, label, per_class))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sized(batches, limit=2 << 20):
            column = batch.column("text")
            counts = text_counts(column)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[c].astype(np.int64)) for c in names],
                 pa.array(model.probability(column))], ["doc_id", *names, "probability"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        score, f"doc_id bigint, {', '.join(f'{c} bigint' for c in names)}, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return scored.select("doc_id", *names, failed.alias("base_failed"), "probability",
                         (~failed & (F.col("probability") >= threshold)).alias("kept"))
