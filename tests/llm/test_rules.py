"""Counts of the quality rules against plain ones, and what the regression learns."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.queries import QUERIES
from tidemark.llm.rules import fit_curve, judge_quality, text_counts

LABELS = "doc_id bigint, quality int"


def plain_counts(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            again += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again,
            len(inside))


def base_failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA \n\t\x0b\xa0é#*|.𐍈", max_size=80)),
                min_size=1, max_size=6))
def test_counts(texts):
    got = text_counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert tuple(int(v[i]) for v in got.values()) == plain_counts(text)


def test_counts_of_whole_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_quality_rules"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == base_failed(want)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_held_out_labels(spark, scale):
    folder = f"/root/testdata/{scale}"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op12_quality_rules"](spark, folder).collect()
            if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
            and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def text_of(rng, words, n=80):
    return " ".join(rng.choices(words, k=n))


def test_held_out_labels_are_not_learnt(spark, make_docs):
    """Labels of the held-out rows may say anything: scores stay the same."""
    rng = random.Random(3)
    good, bad = ([f"{c}{i}" for i in range(60)] for c in "gb")
    rows = [(i, text_of(rng, good if i % 2 else bad)) for i in range(200)]
    docs = make_docs(rows)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)]
    true = spark.createDataFrame([(i, i % 2) for i in range(200)], LABELS)
    other = spark.createDataFrame([(i, 1 - i % 2 if held[i] else i % 2) for i in range(200)], LABELS)
    a, b = ({r.doc_id: r.probability for r in judge_quality(docs, x).collect()}
            for x in (true, other))
    assert a == b
    assert all((a[i] >= 0.5) == bool(i % 2) for i in range(200))


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "w " * 9000),
            (6, " ".join(f"w{i}" for i in range(30_000))), (7, "é" * 5000)]
    docs = make_docs(rows, kept="x", n_words="y")
    none = spark.createDataFrame([], LABELS)
    for labels, verdict in ((none, True), (spark.createDataFrame([(4, 1)], LABELS), True),
                            (spark.createDataFrame([(4, 0), (None, 1), (6, None)], LABELS), False)):
        got = judge_quality(docs, labels).collect()
        assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted(
            (str(i), plain_counts(t)[0]) for i, t in rows)
        assert {r.doc_id: r.kept for r in got} == {
            1: False, 2: False, 3: False, 4: False, None: False, 6: verdict, 7: False}
    assert judge_quality(docs.limit(0), none).collect() == []


def test_a_labelled_id_on_many_rows_teaches_one_text(spark, make_docs):
    rng = random.Random(4)
    good, bad = ([f"{c}{i}" for i in range(60)] for c in "gb")
    rows = [(i, text_of(rng, good if i % 2 else bad)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], LABELS)
    once = judge_quality(make_docs(rows), labels).collect()
    many = judge_quality(make_docs(rows + [rows[4]] * 500), labels).collect()
    assert len(many) == len(once) + 500
    assert {(r.doc_id, r.probability) for r in many} == {(r.doc_id, r.probability) for r in once}


def test_curve_against_a_grid():
    rng = np.random.default_rng(1)
    z = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    weights = np.where(y == 1, 2.0, 1.0)
    a, b = fit_curve(z, y, weights)
    ones, noughts = weights[y == 1].sum(), weights[y == 0].sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (noughts + 2))

    def loss(a, b):
        t = a * z + b
        return (weights * (np.logaddexp(0, t) - target * t)).sum()
    best = loss(a, b)
    assert all(best <= loss(a + da, b + db) + 1e-9 for da in np.linspace(-1, 1, 41)
               for db in np.linspace(-1, 1, 41))
