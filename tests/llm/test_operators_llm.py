"""Operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tidemark.llm import components, jaccard, packing, planes, quality, text as words
from tidemark.llm.components import connected_components
from tidemark.llm.fingerprints import containment, likeness, merged, sketch, with_next
from tidemark.llm.jaccard import join_sets, near_duplicates, one_of_each
from tidemark.llm.lines import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import score_quality
from tidemark.llm.search import exact_top_k
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.tokens import default_path, encoder
from tidemark.llm.toxicity import score_toxicity

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"),
       (5, "word " * 30_000), (6, "é" * 5_000)]


# ---- helpers ------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té.,'0<|>Σẛ",
                                             max_size=40)), min_size=1, max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    e = encoder(default_path())
    assert e.by_chunk and e.by_piece
    ids, offsets = e.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == e.tokenizer.encode(
            t or "", add_special_tokens=False).ids


def test_encoder_special_and_odd_chunks():
    e = encoder(default_path())
    texts = ["a <|endoftext|> b<|startoftext|>c", "x\x1cy z w", "İstanbul don't 'really'",
             "你好 12,345.6 ½", "a" * 300]
    ids, offsets = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == e.tokenizer.encode(
            t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb \n\x0bé.", max_size=30)),
                min_size=1, max_size=6), st.integers(1, 4))
def test_shingle_sets(texts, width):
    import re
    seen = {}
    for t, got in zip(texts, words.shingle_sets(pa.array(texts, pa.string()), width)):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(
            c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        want = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        assert len(got) == len(want)
        for pair in [(frozenset(want), frozenset(got.tolist()))]:
            assert seen.setdefault(pair[0], pair[1]) == pair[1]


# ---- op2 ----------------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def test_search_ties_nulls_and_repeats(spark):
    rows = [(i, [0.5, 0.25]) for i in range(30)] + [
        (0, [0.5, 0.25]), (40, None), (41, [0.5, None]), (42, [float("nan"), 1.0]),
        (43, [float("inf"), 1.0]), (None, [1.0, 1.0]), (60, []), (61, [1.0])]
    got = exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {0, 20, 60}
    assert by[0] == [(1, 61, 2048), *[(n, n - 1, 32 * 32 + 256) for n in range(2, 6)]]
    assert by[60] == [(1, 0, 0), *[(n + 2, n, 0) for n in range(4)]]


def test_search_keeps_every_row_of_an_id(spark):
    """A third of the rows under one id: each is a candidate, whatever its vector."""
    rng = np.random.default_rng(8)
    rows = [(7 if i % 3 == 0 else i + 100, [float(x) for x in rng.integers(-9, 9, 3)])
            for i in range(90)] + [(0, [1.0, 2.0, -1.0]), (7, [9.0, 9.0, -9.0])]
    got = exact_top_k(vectors(spark, rows), F.col("vec_id") == 0, k=40).collect()
    want = sorted((-sum(64 * 64 * a * b for a, b in zip(v, (1, 2, -1))), i)
                  for i, v in rows if i != 0)[:40]
    assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("scale", [1, 1e7, 1e15])
def test_search_against_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x * scale)) for x in rng.standard_normal(5)]) for i in range(60)]
    whole = [[int(np.floor(np.float64(np.float32(x)) * 64)) for x in v] for _, v in rows]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_top_k(
        vectors(spark, rows), F.col("vec_id") % 20 == 0, k=4).collect()}
    limit = (1 << 63) - 1
    for q in (0, 20, 40):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i)
                        for i, v in enumerate(whole) if i != q)
        for n in range(4):
            score = max(-limit, min(limit, -scores[n][0]))
            assert got[q, n + 1] == (scores[n][1], score)


def test_search_without_rows(spark):
    assert exact_top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_top_k(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


# ---- op3 ----------------------------------------------------------------------------------

def test_mixing_meets_the_weights(spark, make_docs):
    docs = make_docs([(i, "x" * 10, "big" if i % 3 else "small") for i in range(6000)])
    got = Counter(r.source for r in mix_sources(docs, {"big": 1.0, "small": 3.0}).collect())
    assert abs(got["small"] / sum(got.values()) - 0.75) < 0.02
    assert abs(sum(got.values()) - 6000) < 300
    big = mix_sources(docs.limit(50), {"big": 0.0, "small": 1.0}, repeat=40.0)
    assert {r.source for r in big.select("source").distinct().collect()} == {"small"}
    assert abs(big.count() - 2000) < 200


def test_mixing_odd_rows(spark, make_docs):
    docs = make_docs([(*r, None) for r in ODD], copy="old")
    out = mix_sources(docs, repeat=3.0, copy_column="copy", key_column="key")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "key"]
    rows = out.collect()
    assert {r["copy"] for r in rows} <= set(range(20))
    assert Counter(r.doc_id for r in rows)[4] % 2 == 0
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, {}).count() == 0


def test_mixing_keeps_rows_without_an_id_of_their_own(spark, make_docs):
    rows = [(None, f"text {i}") for i in range(1500)] + [(None, "all the same")] * 1500
    rows += [(7, f"other {i}") for i in range(1500)] + [(100 + i, "own") for i in range(1500)]
    out = mix_sources(make_docs(rows), key_column="key").collect()
    kinds = Counter((r.doc_id if r.doc_id in (None, 7) else 0, r.text[:3]) for r in out)
    assert len(kinds) == 4 and all(1300 < n < 1700 for n in kinds.values())
    assert len({r.key for r in out}) == len(out)


def test_mixing_uses_no_python(spark, make_docs):
    plan = mix_sources(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- op4 ----------------------------------------------------------------------------------

def plain_components(rows, width, num, den):
    import re
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or (
            {tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in groups[find(i)] if x is not None),
                                           default=None) if sets[i] else r[0])
                   for i, r in enumerate(rows)), key=str)


def edited_copies(seed, groups, copies, size):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(300)]
    common = " ".join(f"c{i}" for i in range(12))
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows) + 10, " ".join(w) if g % 2 else common + "\n" + " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_near_duplicates_against_brute_force(spark, make_docs, width, num):
    rows = edited_copies(width, 6, 12, 60) + ODD + [(7, "One"), (8, "two words"), (9, "two  words")]
    got = near_duplicates(make_docs(rows), width, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, width, num, 100)


def test_near_duplicates_over_many_blocks(spark, make_docs, monkeypatch):
    from tidemark.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "RARE", 3)
    rows = edited_copies(1, 3, 70, 45)
    got = near_duplicates(make_docs(rows), 3, 90, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, 3, 90, 100)


def test_one_of_each(spark, make_docs):
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (9, ""), (8, None), (4, "x y z"), (4, "x y z")]
    out = one_of_each(make_docs(rows))
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 8, 9]
    assert one_of_each(make_docs([])).count() == 0 and out.columns[1] == "text"


def test_one_of_each_decides_by_row(spark, make_docs):
    """Edited copies without ids give one row; an id that another component's representative has
    does not keep a row; rows without words stay."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in (0, 59)] + [" ".join(words)]
    away = [f"v{i}" for i in range(60)]
    rows = [(None, t) for t in near] + [(None, near[0])] * 5
    kept = one_of_each(make_docs(rows)).collect()
    assert len(kept) == 1 and kept[0].doc_id is None
    rows = [(7, near[0]), (5, near[1]), (5, " ".join(away)), (2, " ".join(away[:59] + ["x"])),
            (None, near[2]), (1, ""), (1, " "), (None, None)]
    kept = one_of_each(make_docs(rows, node="n", key="k")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        [(5, near[1]), (2, rows[3][1]), (1, ""), (1, " "), (None, None)])


@pytest.mark.parametrize("rare, num", [(1, 60), (2, 80), (4, 70), (16, 60)])
def test_jaccard_finds_every_link_whatever_is_frequent(spark, make_docs, monkeypatch, rare, num):
    """Few different words, so that most tokens are frequent; groups of copies edited again and
    again, and documents that share passages only."""
    monkeypatch.setattr("tidemark.llm.jaccard.RARE", rare)
    rng = random.Random(rare * 100 + num)
    passages = [[rng.choice("abcde") for _ in range(12)] for _ in range(6)]
    texts = []
    for _ in range(25):
        base = sum(rng.sample(passages, 3), []) + [rng.choice("abcdefgh") for _ in range(15)]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(base))
            for _ in range(rng.randint(1, 3)):
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice("abcdefghij")
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    sets = {i: {tuple(t.split()[k:k + 2]) for k in range(len(t.split()) - 1)} for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in near_duplicates(
        make_docs(docs), width=2, num=num).collect()}
    assert got == {i: find(i) for i in sets}
    assert 1 < len(set(got.values())) < len(got)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


@pytest.mark.parametrize("edges", [
    [(3, 1), (3, 2)],
    [(100 + i, h) for i in range(12) for h in (i % 7, (3 * i + 1) % 7)],  # nodes to heads
    [(50 + i, i + j) for i in range(15) for j in (0, 1)]])
def test_components_of_edges_in_batches_of_their_own(spark, edges):
    frame = spark.createDataFrame(spark.sparkContext.parallelize(edges, len(edges)),
                                  "a bigint, b bigint")
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in connected_components(frame).collect()} == root


@pytest.mark.parametrize("most", [4, 1 << 18])
def test_components_in_rounds_and_in_one_slice(spark, monkeypatch, most):
    """Rounds on shuffled edges end once the rest fits a slice; both ways give the same roots."""
    monkeypatch.setattr(components, "EDGES", most)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(spark.sparkContext.parallelize(edges, 5), "a bigint, b bigint")
    assert {r.node: r.root for r in connected_components(frame).collect()} == root
    assert connected_components(frame.limit(0)).count() == 0


def test_edges_are_contracted_over_batches(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"a": [i + 1], "b": [i]}) for i in range(9)]
    monkeypatch.setattr(components, "EDGES", 5)
    out = [b.to_pydict() for b in components._contract(iter(batches))]
    assert out == [{"a": [1, 2, 3, 4, 5], "b": [0] * 5}, {"a": [6, 7, 8, 9], "b": [5] * 4}]


def test_near_duplicates_run_few_jobs(spark, make_docs, monkeypatch):
    """The driver holds plans and states of all jobs: large clusters may not take ever more."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.02 * (i % 5) else f"x{rng.randrange(30)}"
                         for w in base)) for i in range(60)]
    spark.sparkContext.setJobGroup("few", "few")
    try:
        got = {r.doc_id: r.component_id for r in near_duplicates(make_docs(docs), 3, 60).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    sets = {i: {tuple(t.split()[k:k + 3]) for k in range(58)} for i, t in docs}
    near = [(i, j) for i in sets for j in sets
            if i < j and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert got == root
    assert jobs < 125  # 105 here, 149 with rounds for few edges and tiles planned twice


def test_join_sets_links_each_group_once():
    sets = [np.arange(100, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64),
            np.arange(2, 102, dtype=np.uint64), np.arange(500, 520, dtype=np.uint64)]
    prefixes = [(s, 1) for s in sets]
    assert join_sets(sets, prefixes, np.arange(4), np.zeros(4, int), 90, 100) == [(1, 0), (2, 0)]
    assert join_sets(sets, prefixes, np.array([5, 9, 9, 5]), np.array([1, 2, 1, 2]), 90, 100) == [(1, 0)]


def test_prefix_of_rare_tokens_asks_for_more_than_one():
    """Counters that show nothing beyond noise do not make one shared token enough."""
    tokens = words.mix64(np.arange(2000, dtype=np.uint64))
    prefix, least = jaccard.adaptive_prefix(tokens, np.full(1 << 10, 7, np.uint32), 7.0, 90, 100)
    assert least == jaccard.MOST_SHARED and len(prefix) == 200 + least


@pytest.mark.parametrize("top", [1, 255, 256, 70_000])
def test_counters_round_trip(top):
    counters = np.random.default_rng(top).integers(0, 2, jaccard._CHUNK).astype(np.uint32)
    counters[7] = top
    data = jaccard._packed(counters)
    assert (jaccard._unpacked(data) == counters).all()
    assert len(data) < jaccard._CHUNK / 2  # two bytes of each counter went out before
    assert jaccard._packed(np.zeros(jaccard._CHUNK, np.uint32)) == b""


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_marks_keep_every_node_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MAX_MARKS", most)
    rows = spark.range(20_000).select(F.expr("id * 8589934592 + id % 3").alias("node"), "id")
    some = rows.filter("id % 10 = 0").select("node")
    kept = {r.id for r in jaccard._marked(rows, some).collect()}
    assert kept >= set(range(0, 20_000, 10)) and len(kept) < 4_000
    assert jaccard._marked(rows, some.limit(0)).count() == 0


# ---- op5 ----------------------------------------------------------------------------------

def test_fingerprints_odd_rows(spark, make_docs):
    rows = {(r.doc_id, r.text): r for r in with_next(make_docs(ODD, sketch="old")).collect()}
    assert len(rows) == len(ODD) - 1  # equal rows are one key here
    assert rows[1, ""].next_text == "no id here at all"
    assert rows[None, "no id here at all"].next_text == ODD[-1][1]
    assert rows[6, ODD[-1][1]].next_text == ODD[-2][1]
    assert with_next(make_docs([])).count() == 0
    one = with_next(make_docs([(7, "a b")])).first()
    assert one.next_text == "a b" and one.sketch == one.next_sketch


def hot_rows(n):
    """A third of the rows without an id, a sixth under one id, some of them equal."""
    rows = [(i * 7, f"own {i} " * (i % 5 + 1)) for i in range(n // 2)]
    rows += [(None, f"no id {i % (n // 3 - 5)}") for i in range(n // 3)]
    return rows + [(42, f"the same id {i}") for i in range(n - len(rows) - 1)] + [(42, None)]


def test_next_with_hot_ids(spark, make_docs):
    rows = hot_rows(600)
    hashed = make_docs(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                                    F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(hashed, key=lambda r: (-1 << 63 if r.doc_id is None else r.doc_id, r.h),
                   reverse=True)
    want = Counter((a.doc_id, a.text, b.text) for a, b in zip(order, order[1:] + order[:1]))
    found = with_next(make_docs(rows))
    got = found.collect()
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want
    sketches = {r.text: r.sketch for r in got}
    assert all(r.next_sketch == sketches[r.next_text] for r in got)
    # The window that holds most rows: a slice of an id's hashes, not the id.
    many = found.groupBy("doc_id", F.shiftright(F.xxhash64("text"), 48)).count()
    assert many.agg(F.max("count")).first()[0] <= 4


def test_next_of_one_repeated_id_only(spark, make_docs):
    got = with_next(make_docs([(None, "a"), (None, "b"), (None, "b")])).collect()
    assert Counter(r.text for r in got) == {"a": 1, "b": 2}
    assert Counter(r.next_text for r in got) == {"a": 1, "b": 2}


def test_next_over_far_ids(spark, make_docs):
    ids = [-(1 << 62), -5, 0, 1, 4095, 4096, 1 << 20, (1 << 20) + 1, 1 << 40, (1 << 62) + 3]
    got = {r.doc_id: r.next_text for r in with_next(make_docs([(i, str(i)) for i in ids])).collect()}
    assert got == {i: str(j) for i, j in zip(ids, ids[-1:] + ids[:-1])}


def test_sketches_merge_and_contain(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    part, tail = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(396, 4000))
    a, b, c = (sketch(F.lit(t)) for t in (part, long, tail))
    row = spark.range(1).select(
        containment(a, b).alias("ab"), containment(b, a).alias("ba"),
        likeness(merged(a, c), b).alias("whole"), likeness(a, a).alias("same")).first()
    assert row.ab == 1.0 and abs(row.ba - 0.1) < 0.05 and row.whole == 1.0 and row.same == 1.0


# ---- op1, op6 -----------------------------------------------------------------------------

@pytest.mark.parametrize("score,label", [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_classifiers_odd_rows(spark, make_docs, score, label):
    docs = make_docs(ODD, score="old", severity="old")
    schema = f"doc_id bigint, {label} int"
    some = [(i, i % 2) for i in range(1, 7)] + [(None, 1), (2, None), (4, 0), (77, 1)]
    for rows in (some, [(1, 1)], []):
        out = score(docs, spark.createDataFrame(rows, schema)).collect()
        assert len(out) == len(ODD)
        for r in out:
            value = r["score"] if label == "quality" else r["severity"]
            assert 0.0 <= value <= 3.0
    assert score(docs.limit(0), spark.createDataFrame(some, schema)).count() == 0


@pytest.mark.parametrize("chars", [5, 8000])
def test_quality_scores_large_batches_in_little_memory(chars):
    texts = ["Ab, cd 1. " * (chars // 10) or "Ab 1."] * (8_000_000 // max(chars, 2000))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = quality.features(pa.array(["a b", "Cd 12.", "x\ny"]))

    class Shared:
        value = quality.fit(rows, np.array([0.0, 1.0, 1.0]))

    tracemalloc.start()
    found = sum(part.num_rows for part in quality._score(Shared, ["doc_id"])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(texts) and peak < 48 << 20


def test_quality_learns_in_little_memory():
    """The sample is weighted in the driver in place, with the same numbers."""
    rows = (np.random.default_rng(3).random((2000, quality.WIDTH)) > 0.97).astype(np.float32)
    rarity = np.log(2001.0 / (1.0 + (rows > 0).sum(axis=0))).astype(np.float32) + 0.1
    want, size = quality._balanced(rows, rarity), rows.nbytes
    tracemalloc.start()
    model = quality.fit(rows, np.arange(2000) % 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size and (rows == want).all()
    assert (model.vectors == quality._unit(want @ model.basis)).all()


def test_packing_encodes_slices_of_bounded_size(spark, make_docs, monkeypatch):
    docs = make_docs([(i, f"word {i} of a text\n" * (i % 7 * 50)) for i in range(60)]).coalesce(1)
    want = sorted(packing.token_pieces(docs).collect())
    monkeypatch.setattr(packing, "_SLICE", 1 << 12)
    assert sorted(packing.token_pieces(docs).collect()) == want


def test_quality_without_labels_is_even(spark, make_docs):
    out = score_quality(make_docs([(1, "a")]), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert out.first().score == 0.5


# ---- op7 ----------------------------------------------------------------------------------

def test_secrets(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, f"some words token = \"{rng.randbytes(20).hex()}\" and more") for i in range(40)]
    rows += [(100 + i, "see https://host.example/path/to/a/very/long/" + "page" * 5) for i in range(40)]
    rows += [(200 + i, "internationalizationofthings and words") for i in range(40)] + ODD
    out = scan_secrets(make_docs(rows, value="old")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.p_secret <= 1 and r.is_secret == (r.p_secret >= 0.5)
    for i in range(40):
        assert [x.is_secret for x in by[i]] == [1]
        assert rows[i][1][by[i][0].start:][:40] == by[i][0].value
        assert not any(x.is_secret for x in by.get(100 + i, []) + by.get(200 + i, []))
    assert scan_secrets(make_docs([])).count() == 0


def test_secrets_in_other_forms(spark, make_docs):
    rng = random.Random(6)
    alnum = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    def pick(n):
        return "".join(rng.choice(alnum) for _ in range(n - 3)) + "a7Q"
    want = {}
    rows = []
    for i in range(30):
        jwt = f"eyJ{pick(20)}.eyJ{pick(30)}.{pick(25)}"
        for before, value in [
                ("API_KEY=", rng.randbytes(16).hex()), ("see ?token=", rng.randbytes(16).hex()),
                ("export AWS_SECRET_ACCESS_KEY=", pick(40)), ("password: ", "hunter2pass" + str(i)),
                ("password: ", "p.s$" + pick(8)), ("Authorization: Bearer ", jwt), ("so ", jwt),
                ("here is ", "AKIA" + pick(16).upper().replace("A", "B"))]:
            want[len(rows)] = (len(before), value)
            rows.append((len(rows), before + value + " and more"))
    bare = len(rows)
    for i in range(10):
        rows.append((bare + i, "so " + (value := pick(32)) + " was used"))
        want[bare + i] = (3, value)
    plain = len(rows)
    rows += [(plain + i, "internationalizationofthings and words") for i in range(40)]
    rows += [(plain + 40 + i, "password: required and more") for i in range(20)]
    rows += [(plain + 60, "token=" + "a1," * 20_000), (plain + 61, "longpartofaname1." * 20_000)]
    by = {}
    for r in scan_secrets(make_docs(rows)).collect():
        by.setdefault(r.doc_id, []).append(r)
    for i, (start, value) in want.items():
        assert [(x.start, x.value, x.is_secret) for x in by[i]] == [(start, value, 1)], rows[i]
    assert not any(x.is_secret for i in range(plain, plain + 60) for x in by.get(i, []))


def test_secrets_of_any_length_and_in_addresses(spark, make_docs):
    rng = random.Random(8)
    alnum = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    def pick(n):
        return "".join(rng.choice(alnum) for _ in range(n - 3)) + "a7Q"
    rows, want = [], {}
    def add(before, value, after=" and more"):
        want[len(rows)] = (len(before), value)
        rows.append((len(rows), before + value + after))
    for i in range(20):
        add('password = "', " ".join(pick(9) for _ in range(60)), '" end')
        add("\U0001f511 token='", pick(5_000), "' end")
        add("token=", ";".join(pick(12) for _ in range(300)))
        add("so ", ".".join(pick(20) for _ in range(80)))
        add("postgres://admin:", "s3cr" + pick(5), "@db.example:5432/x")
        add("see \U0001f511 mongodb+srv://" + "long-user-name" * 5 + ":", pick(9) + "@x", "@db/x")
        add("pw: ", "hunter2pass" + str(i))
        add("pass=", "p.s$" + pick(8))
        add("\ufdd0 x \ufdd0\ufdd0 api_key: ", pick(24))
    plain = len(rows)
    rows += [(plain + i, t) for i, t in enumerate(
        ["https://user:password@host/x", "https://host.example:8080/path/to/a/page",
         "internationalizationofthings and words", "they pass 1234abcd, pw 1234abcd on",
         "a://b:" + "c" * 50_000, 'token="' * 5_000, "token=" + "&;" * 20_000] * 5)]
    by = {}
    for r in scan_secrets(make_docs(rows)).collect():
        by.setdefault(r.doc_id, []).append(r)
        assert rows[r.doc_id][1][r.start:][:len(r.value)] == r.value
    for i, (start, value) in want.items():
        assert [(x.start, x.value, x.is_secret) for x in by.get(i, [])] == [(start, value, 1)], rows[i]
    for i in range(plain, len(rows)):
        assert (i - plain) % 7 > 3 or not any(x.is_secret for x in by.get(i, [])), rows[i]


# ---- op8 ----------------------------------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plan_fills_bins(counts):
    capacity, bins = 64, {}
    seen = Counter()
    for length, rank, first, each, offset in sorted(packing.plan_bins(counts, capacity)):
        assert rank == seen[length]
        stop = min([p[1] for p in packing.plan_bins(counts, capacity)
                    if p[0] == length and p[1] > rank], default=counts[length])
        for r in range(stop - rank):
            bins.setdefault(first + r // each, []).append((offset + r % each * length, length))
        seen[length] = stop
    assert seen == counts
    assert sorted(bins) == list(range(len(bins)))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in places) <= 2


def test_packing_odd_rows(spark, make_docs):
    rows = packing.pack_documents(make_docs(ODD, length="old")).collect()
    assert Counter(r.doc_id for r in rows)[4] == 2
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(make_docs([])).count() == 0


# ---- op9 ----------------------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=70), st.sampled_from(["byte", "bit"]),
       st.integers(1, 16))
def test_planes_round_trip(ids, kind, block):
    ids = np.array(ids, np.uint32)
    index, payload = planes.pack_ids(ids, kind, block)
    assert (planes.unpack_ids(index, payload, len(ids), kind, block) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_odd_rows(spark, make_docs, tmp_path, monkeypatch, kind):
    path = str(tmp_path / "tokens")
    planes.write_tokens(make_docs(ODD, shard="old"), path, planes=kind, block_ids=1000)
    rows = planes.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()
    e = encoder(default_path()).tokenizer
    texts = {i: t for i, t in ODD}
    for r in rows:
        want = e.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want
    path = str(tmp_path / "none")
    planes.write_tokens(make_docs([]), path)
    assert planes.read_tokens(spark, path).count() == 0


def test_token_files_with_hot_ids(spark, make_docs, tmp_path, monkeypatch):
    rows, path = hot_rows(3000), str(tmp_path / "tokens")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    for k in before:
        spark.conf.set(k, "false")
    try:
        planes.write_tokens(make_docs(rows).repartition(3), path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shards = spark.read.parquet(path).groupBy("shard").agg(
        F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(shards) == 4 and max(r.n for r in shards) < 1200  # ids alone would give 1000 + 750
    monkeypatch.setattr(planes, "BROADCAST_SHARDS", 0)
    got = planes.read_tokens(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    e = encoder(default_path()).tokenizer
    want = Counter((i, tuple(e.encode(t or "", add_special_tokens=False).ids + [2]))
                   for i, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want


# ---- op10 ---------------------------------------------------------------------------------

def plain_lines(rows, min_docs, min_chars, keep_first):
    def keys(t):
        return ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
                for x in (t or "").split("\n")]
    held = Counter(k for _, t in rows for k in set(keys(t)) if len(k) >= min_chars)
    out, first = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k in keys(t):
            first.setdefault(k, i)
    for i, t in rows:
        stay, spared = [], set()
        for line, k in zip((t or "").split("\n"), keys(t)):
            gone = len(k) >= min_chars and held[k] >= min_docs
            if gone and keep_first and first[k] == i and k not in spared:
                spared.add(k)
                gone = False
            if not gone:
                stay.append(line)
        out.append((i, "\n".join(stay), len((t or "").split("\n")),
                    len((t or "").split("\n")) - len(stay)))
    return sorted(out)


@pytest.mark.parametrize("min_docs,min_chars,keep_first",
                         [(3, 1, False), (2, 1, True), (2, 4, False), (1, 1, False), (2, 0, True)])
@pytest.mark.parametrize("bits", [1 << 20, 64 * 8])
def test_lines_against_brute_force(spark, make_docs, min_docs, min_chars, keep_first, bits):
    rng = random.Random(min_docs)
    lines = ["Alpha", " alpha\t", "beÉ", "beé", "", "  ", "gamma ray", "\x0bGAMMA ray", "d"]
    lines += [f"own {i}" for i in range(200)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, "x\n" * 20_000)]
    docs = make_docs(rows, n_lines="old", digest="old")
    got = dedup_lines(docs, min_docs, min_chars, keep_first, bits)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "digest", "text", "n_lines",
                           "n_dropped"]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect())
    assert got == plain_lines(rows, min_docs, min_chars, keep_first)


def test_lines_repeated_rows_and_no_rows(spark, make_docs):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nc")]
    got = dedup_lines(make_docs(rows), min_docs=3)
    assert sorted(r.text for r in got.collect()) == ["b", "b", "c"]
    assert dedup_lines(make_docs([]), min_docs=3).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_with_hot_ids(spark, make_docs, keep_first):
    """A third of the rows under no id or one id: each row loses its own lines."""
    rows = [(i, f"common {i % 40}\nown {i}\ncommon {i % 7}") for i in range(300)]
    rows += [(5000, f"common {i % 40}\nhot {i}\nhot {i // 3}") for i in range(150)]
    if not keep_first:
        rows += [(None, f"common {i % 40}\nnone {i // 2}\n\nnone") for i in range(150)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text, r.n_lines, r.n_dropped)
                 for r in dedup_lines(make_docs(rows), 3, 1, keep_first).collect())
    rows = [(-1 if i is None else i, t) for i, t in rows]
    assert got == plain_lines(rows, 3, 1, keep_first)
