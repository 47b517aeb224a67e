"""Quality by the votes of labelled neighbours among latent-semantic vectors.

A text's terms are the triples of its sequence of character kinds (lower case, upper case, digit,
blank, line end, other letters, and every ASCII mark on its own), with runs of one kind taken
together, and a few terms for how much it repeats and what it is made of. Counts are damped,
weighted by how rare a term is and projected on the leading singular vectors of a labelled sample.
The sample's vectors are broadcast; every document gets exact cosines with all of them, in blocks,
and the labels of the nearest vote with a power of their similarity.

Only texts enter a score. Defined cases: a null text is empty; an empty text has the terms of an
empty text and is scored by them; rows with a null or repeated doc_id are scored each; without
labels of both classes the score is that of the only class, or 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, labelled_texts
from .text import sized, utf8, word_hashes

#: Labelled documents of each class that the model may learn from.
PER_CLASS = 2048
HASHED, RANK, NEIGHBOURS, POWER = 4096, 48, 31, 8
_LEVELS = 12
#: Bytes and rows of text that a task works on at once: arrays of a row are thousands of numbers.
_SLICE, _ROWS = 1 << 19, 128
_STATS = ("words", "distinct", "adjacent", "length", "upper", "marks", "digits", "lines")
WIDTH = HASHED + len(_STATS) * _LEVELS


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.int64)
    kinds[128:] = 1
    kinds[97:123], kinds[65:91], kinds[48:58] = 2, 3, 4
    kinds[[9, 11, 12, 13, 32]], kinds[10] = 5, 6
    marks = [b for b in range(33, 127) if kinds[b] == 0]
    kinds[marks] = np.arange(7, 7 + len(marks))
    return kinds


_KIND = _kinds()


def _level(value: np.ndarray, step: float) -> np.ndarray:
    return np.clip(np.floor(value / step), 0, _LEVELS - 1).astype(np.int64)


def features(column: pa.Array) -> np.ndarray:
    """Damped term counts of each text, one row each, before rarity weights."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kind = _KIND[data]
    if len(data):
        change = np.flatnonzero(np.concatenate(
            [[True], (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])]))
        k, r = kind[change], row[change]
        if len(k) > 2:
            code = (k[:-2] * 64 + k[1:-1]) * 64 + k[2:]
            same = r[:-2] == r[2:]
            # The high bits of a product spread codes over the columns.
            code = (code * 2654435761 % (1 << 32)) * HASHED >> 32
            count = np.bincount((r[:-2] * HASHED + code)[same], minlength=rows * HASHED)
            out[:, :HASHED] = np.log1p(count.reshape(rows, HASHED))

    def share(mask):
        return np.bincount(row[mask], minlength=rows) / np.maximum(np.diff(offsets), 1)

    words, first = word_hashes(column)
    count = np.diff(first)
    of = np.repeat(np.arange(rows), count)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1], first[1:])])
    adjacent = np.zeros(rows)
    if len(words) > 1:
        adjacent = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])],
                               minlength=rows)
    some = np.maximum(count, 1)
    stats = {
        "words": _level(np.log2(count + 1.0), 1.5),
        # Texts use their words again the more, the longer they are.
        "distinct": _level(np.log(np.maximum(distinct, 1)) / np.log(np.maximum(count, 2)), 0.09),
        "adjacent": _level(np.sqrt(adjacent / some), 0.09),
        "length": _level(np.log2(np.diff(offsets) / some + 1.0), 0.5),
        "upper": _level(np.sqrt(share(kind == 3)), 0.09),
        "marks": _level(np.sqrt(share(kind > 6)), 0.09),
        "digits": _level(np.sqrt(share(kind == 4)), 0.09),
        "lines": _level(np.log2(np.bincount(row[kind == 6], minlength=rows) + 1.0), 1.0),
    }
    for n, name in enumerate(_STATS):
        out[np.arange(rows), HASHED + n * _LEVELS + stats[name]] = 1.0
    return out


@dataclass(frozen=True)
class Neighbours:
    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space."""
        return _unit(_balanced(rows, self.rarity) @ self.basis)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosine = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k:]
        vote = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 1e-3).astype(np.float64)
        vote **= POWER
        return np.clip((vote * self.labels[nearest]).sum(axis=1) / vote.sum(axis=1), 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _balanced(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rarity weights, with equal lengths for the triples and for the other terms."""
    rows = rows * rarity
    for part in (rows[:, :HASHED], rows[:, HASHED:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return rows


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Neighbours:
    """Latent space of a labelled sample, by a randomized singular value decomposition. ``rows``
    are weighted in place, as this runs in the driver."""
    if not len(rows):
        return Neighbours(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32),
                          np.zeros((0, 1), np.float32), labels)
    rarity = np.log((1.0 + len(rows)) / (1.0 + (rows > 0).sum(axis=0))).astype(np.float32) + 0.1
    for start in range(0, len(rows), _ROWS):
        rows[start:start + _ROWS] = _balanced(rows[start:start + _ROWS], rarity)
    weighted = rows
    rank = min(rank, *weighted.shape)
    guess = np.random.default_rng(7).standard_normal(
        (weighted.shape[1], min(rank + 10, weighted.shape[1]))).astype(np.float32)
    for _ in range(3):
        guess, _ = np.linalg.qr(weighted.T @ (weighted @ guess))
    _, _, right = np.linalg.svd(weighted @ guess, full_matrices=False)
    basis = (guess @ right.T)[:, :rank].astype(np.float32)
    return Neighbours(rarity, basis, _unit(weighted @ basis), labels)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, limit=_SLICE):
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = features(batch.column("text"))
        at = [np.flatnonzero(row) for row in found]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "label": batch.column("label"),
            "at": pa.array(at, pa.list_(pa.int32())),
            "value": pa.array([row[i] for row, i in zip(found, at)], pa.list_(pa.float32()))})


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                per_class: int = PER_CLASS) -> Neighbours:
    """Learn from at most ``per_class`` labelled documents of each class."""
    texts, _ = labelled_texts(docs, labels, label, per_class)
    sample = texts.mapInArrow(
        _sparse, "doc_id bigint, label int, at array<int>, value array<float>").toArrow()
    sample = sample.sort_by("doc_id").combine_chunks()
    at = sample.column("at").combine_chunks()
    rows = np.zeros((len(sample), WIDTH), np.float32)
    rows[np.repeat(np.arange(len(sample)), at.value_lengths().to_numpy()),
         at.flatten().to_numpy()] = sample.column("value").combine_chunks().flatten().to_numpy()
    return fit(rows, sample.column("label").to_numpy().astype(np.float64))


def _score(shared, keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _slices(batches):
            found = model.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(found, pa.float64())],
                keep + ["__score"])
    return score


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                  threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """The columns of ``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold``) and
    ``held_out``. Input columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, label, per_class))
    keep = [c for c in docs.columns if c not in ("score", "predicted", "held_out")]

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    scored = docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(
        _score(shared, keep), f"{fields}, __score double")
    return scored.select(
        *[F.col(f"`{c}`") for c in keep], held_out().alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"))
