"""Near words by pairs of trie nodes, against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.spelling import count_words, near_words, number_nodes, spelling_variants


def plain_counts(rows, every, min_chars=5, min_count=3):
    seen = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            if every:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= min_count}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, ratio=2):
    out, form = {}, {}
    for w in words:
        close = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        best = close[0] if close else None
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
        out[w] = [form[w], w, words[w], len(close), words[best] if form[w] else None]
    for w in words:
        while form[out[w][1]] is not None:
            out[w][1] = form[out[w][1]]
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def random_docs(seed, n, letters):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randint(4, 7))) for _ in range(12)]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice((0, 0, 1, 2))):
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:],
                            w[:i] + rng.choice(letters) + w[i + 1:]))
        return w
    return [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("seed, letters, every", [(1, "ab", 0), (2, "abcé", 7), (3, "aAbÀÿ÷", 3)])
def test_against_all_pairs(spark, make_docs, seed, letters, every):
    rows = random_docs(seed, 150, letters)
    docs = make_docs(rows).repartition(5)
    words = plain_counts(rows, every)
    assert len(words) > 30
    assert {r.word: r.n for r in count_words(docs, damage_every=every).collect()} == words
    assert result(spelling_variants(docs, damage_every=every)) == plain_variants(words)


def test_odd_rows(spark, make_docs):
    """Nulls, empty and long texts, repeated rows, a column named like an output's."""
    long = "z" * 3000
    rows = [(1, None), (2, ""), (None, "spell spell spell"), (None, "spell spell spell"),
            (4, "spelt spelt spelt"), (4, "spelt spelt spelt"), (5, f"{long} {long} {long}"),
            (6, f"{long}z " * 3), (7, "Spell ÉTUDE étude éTUDE 12 ab-cd " * 3), (8, "one two " * 9)]
    docs = make_docs(rows, word="x", n="y")
    assert result(spelling_variants(docs)) == plain_variants(plain_counts(rows, 0))
    assert result(spelling_variants(docs, damage_every=2)) == plain_variants(plain_counts(rows, 2))
    empty = spelling_variants(docs.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert empty.collect() == []


def test_chain_of_forms(spark, make_docs):
    """A form of a form, and so on: each has twice as many occurrences."""
    words = ["abcde", "abcdf", "abcgf", "abhgf", "aihgf", "jihgf"]
    docs = make_docs([(i, f"{w} " * 3 * 2 ** i) for i, w in enumerate(words)])
    got = result(spelling_variants(docs))
    assert {w: v[0] for w, v in got.items()} == dict(zip(words, words[1:] + [None]))
    assert {v[1] for v in got.values()} == {"jihgf"}


def test_ties_go_to_the_smaller_word(spark, make_docs):
    docs = make_docs([(1, "crate " * 3 + "grate " * 8 + "irate " * 8 + "crane " * 7)])
    assert result(spelling_variants(docs))["crate"] == ("grate", "grate", 3, 3, 8)


def test_nodes_are_one_number_each(spark, tmp_path):
    """Tasks agree on nodes that begin in an earlier range: as many numbers as prefixes."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(800)})
    path = str(tmp_path / "words")
    spark.createDataFrame([(w, 3) for w in words], "word string, n bigint").write.parquet(path)
    for key, shown in ((F.col("word"), str), (F.reverse("word"), lambda w: w[::-1])):
        numbered, right = number_nodes(spark.read.parquet(path), key)
        names, rows = {}, numbered.collect()
        assert len({r.task for r in rows}) > 1
        for r in rows:
            own, other = right.get(r.task, (np.zeros(0), np.zeros(0)))
            fix = dict(zip(own.tolist(), other.tolist()))
            for depth, node in enumerate(r.nodes):
                assert names.setdefault(shown(r.word)[:depth], fix.get(node, node)) == fix.get(
                    node, node)
        assert len(set(names.values())) == len(names)
    ids, _ = near_words(spark.read.parquet(path))
    assert [r.word for r in sorted(ids.collect(), key=lambda r: r.id)] == words
