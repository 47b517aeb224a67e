"""Spelling variants: words one insertion, deletion or replacement apart, and what they stand for.

Words are nodes of a trie read forwards and of one read backwards; nodes of both are numbered. A
word of ``L`` letters without its letter ``i`` is the pair (node of the letters before it, node of
the letters after it), and the gap at ``i`` of a word is a pair as well. Two words with one pair
of the first kind differ by a replaced letter. A word whose gap is the pair of another one lacks
just that letter. So equal pairs of integers are exact neighbours, with no distance left to check.
A letter next to an equal one leaves the same word as its neighbour does; only the first letter
of such a run is compared with gaps, so each pair of words meets once.

Numbering: words are sorted in ranges and each task walks its range with the path of the last
word, so that a node is made once where its words begin. A node that begins in an earlier range
is found from the first and last word of each range, one row per task.

A pair is held by at most one word per letter of the alphabet plus one gap (91 here), which
bounds every group; neighbours are counted and the best one chosen in the group, and no pairs of
words are written.

Defined cases: a null text has no words; a null doc_id stands as the empty string in front of the
colon; rows with one doc_id count each; no documents give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import new_path
from .text import sized

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words a task counts before it hands them on.
_HELD = 300_000
_GAP, _LETTER, _FIRST = 0, 1, 2  # what a pair is of a word; the last: a letter unlike the one before


def _count(every: int, min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "word": pa.array(list(seen), pa.string()),
                "n": pa.array(list(seen.values()), pa.int64())})

        for batch in sized(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").to_pylist()):
                # Only ASCII letters change when bytes are lower-cased.
                runs = Counter(_RUN.findall((text or "").encode().lower().decode()))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    if len(run) < min_chars:
                        continue
                    if every:
                        h = zlib.crc32(run.encode(), start)
                        if h % every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < min_chars:
                                continue
                    seen[run] += n
                if len(seen) > _HELD:
                    yield counted()
                    seen.clear()
        if seen:
            yield counted()
    return count


def count_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3,
                damage_every: int = 0) -> DataFrame:
    """``word`` and ``n``: lower-cased runs of letters of at least ``min_chars`` code points with
    ``min_count`` occurrences. With ``damage_every``, runs whose crc32 of ``doc_id:run`` it divides
    lose the letter at that number modulo their length."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _count(damage_every, min_chars), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the path of each word of a sorted range, numbered in the order they begin."""
    task = TaskContext.get().partitionId()
    path: list[int] = []
    last, made = "", task << 40
    for batch in sized(batches, "key", 1 << 20):
        nodes, ends = [], [0]
        for key in batch.column("key").to_pylist():
            del path[_common(last, key) + 1:]
            fresh = len(key) + 1 - len(path)
            path.extend(range(made, made + fresh))
            made += fresh
            last = key
            nodes.append(np.array(path, np.int64))
            ends.append(ends[-1] + len(path))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(np.concatenate(nodes), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"), batch.column("key"), lists,
             pa.array(np.full(batch.num_rows, task), pa.int32())],
            ["word", "n", "key", "nodes", "task"])


def number_nodes(words: DataFrame, key: Column) -> tuple[DataFrame, dict[int, tuple]]:
    """The words with the nodes on the path of their ``key``, and for each task the nodes it made
    that belong to an earlier one: (its numbers, ascending; the right numbers).

    The second has an entry per task, each as long as the path its first word shares with the word
    before it.
    """
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "trie")
    words.select("word", "n", key.alias("key")).repartitionByRange(parts, "key") \
        .sortWithinPartitions("key").mapInArrow(
            _walk, "word string, n bigint, key string, nodes array<bigint>, task int") \
        .write.parquet(path)
    numbered = spark.read.parquet(path)
    both = F.struct("key", "nodes")
    ends = numbered.groupBy("task").agg(
        F.min_by(both, "key").alias("first"), F.max_by(both, "key").alias("last")).collect()
    right: dict[int, tuple] = {}
    before = None
    for row in sorted(ends, key=lambda r: r.task):
        own: list[int] = []
        if before is not None:
            own = row.first.nodes[:_common(before[0], row.first.key) + 1]
            right[row.task] = (np.array(own, np.int64), np.array(before[1][:len(own)], np.int64))
        known = dict(zip(own, before[1])) if own else {}
        before = (row.last.key, [known.get(x, x) for x in row.last.nodes])
    return numbered.select("word", "n", "task", "nodes"), right


def _flat(batch: pa.RecordBatch, nodes: str, task: str, right: dict[int, tuple]) -> np.ndarray:
    """All paths of a batch one after another, with the numbers every task agrees on."""
    lists = batch.column(nodes)
    values = lists.flatten().to_numpy(zero_copy_only=False).copy()
    of = np.repeat(batch.column(task).to_numpy(), lists.value_lengths().to_numpy())
    for t in np.unique(of).tolist():
        if t in right:
            own, other = right[t]
            place = np.minimum(np.searchsorted(own, values), len(own) - 1)
            hit = (of == t) & (own[place] == values)
            values[hit] = other[place[hit]]
    return values


def _pairs(shared):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = shared.value
        for batch in sized(batches, "word", 1 << 18):
            words = batch.column("word").to_pylist()
            size = np.array([len(w) for w in words])
            left = _flat(batch, "before", "before_task", right[0])
            back = _flat(batch, "after", "after_task", right[1])
            letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            start = np.cumsum(size + 1) - (size + 1)       # paths have one node more than letters
            number = left[start + size]                    # a word's own node
            row = np.repeat(np.arange(len(words)), size + 1)
            at = np.arange(len(row)) - start[row]
            gap = (left, back[start[row] + size[row] - at], np.full(len(row), _GAP), row)
            inner = np.flatnonzero(at < size[row])
            row, at = row[inner], at[inner]
            other = np.ones(len(row), bool)
            other[1:] = (at[1:] == 0) | (letters[1:] != letters[:-1])
            letter = (left[start[row] + at], back[start[row] + size[row] - 1 - at],
                      np.where(other, _FIRST, _LETTER), row)
            p, s, kind, row = (np.concatenate(x) for x in zip(gap, letter))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(s), pa.array(kind.astype(np.int32)), pa.array(number[row]),
                 pa.array(-batch.column("n").to_numpy()[row])], ["p", "s", "kind", "id", "less"])
    return pairs


def _numbers(shared):
    """A word's own node: numbers in code-point order of the words."""
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "word", 1 << 18):
            last = np.cumsum(batch.column("nodes").value_lengths().to_numpy()) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"),
                 pa.array(_flat(batch, "nodes", "task", shared.value[0])[last])],
                ["word", "n", "id"])
    return numbers


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered words (``id`` in code-point order, ``word``, ``n``), and for those with near words
    ``id``, ``n_near`` and ``best``: (minus its n, id) of the near word of largest n, ties to the
    smaller word. ``words`` has different ``word`` values and their ``n``; it is read twice, so
    give a written table."""
    forward, fix_forward = number_nodes(words, F.col("word"))
    backward, fix_backward = number_nodes(words, F.reverse("word"))
    shared = words.sparkSession.sparkContext.broadcast((fix_forward, fix_backward))
    numbered = forward.mapInArrow(_numbers(shared), "word string, n bigint, id bigint")
    paths = forward.select("word", "n", F.col("nodes").alias("before"),
                           F.col("task").alias("before_task")).join(
        backward.select("word", F.col("nodes").alias("after"), F.col("task").alias("after_task")),
        "word")
    pairs = paths.mapInArrow(_pairs(shared), "p bigint, s bigint, kind int, id bigint, less bigint")
    met = pairs.groupBy("p", "s").agg(
        F.array_sort(F.collect_list(F.struct("less", "id", "kind"))).alias("m")).filter(
        F.size("m") > 1)
    # In the order of the groups' members the best comes first.
    met = met.select(
        F.filter("m", lambda x: x["kind"] != _GAP).alias("cut"),
        F.filter("m", lambda x: x["kind"] == _FIRST).alias("first"),
        F.filter("m", lambda x: x["kind"] == _GAP).alias("gap"))

    def choice(x: Column) -> Column:
        return F.when(x.isNotNull(), F.struct(x["less"].alias("less"), x["id"].alias("id")))

    def of_cut(x: Column) -> Column:
        other = choice(F.when(F.get("cut", F.lit(0))["id"] == x["id"], F.get("cut", F.lit(1)))
                       .otherwise(F.get("cut", F.lit(0))))
        shorter = choice(F.when(x["kind"] == _FIRST, F.get("gap", F.lit(0))))
        return F.struct(
            x["id"].alias("id"),
            (F.size("cut") - 1 + shorter.isNotNull().cast("int")).cast("bigint").alias("n_near"),
            F.least(other, shorter).alias("best"))

    def of_gap(x: Column) -> Column:
        return F.struct(x["id"].alias("id"), F.size("first").cast("bigint").alias("n_near"),
                        choice(F.get("first", F.lit(0))).alias("best"))

    found = met.select(F.explode(F.concat(F.transform("cut", of_cut), F.transform("gap", of_gap)))
                       .alias("r")).select("r.*").filter(F.col("n_near") > 0)
    return numbered, found.groupBy("id").agg(
        F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _last_of_chain(forms: DataFrame) -> DataFrame:
    """``id`` and the ``root`` that its forms lead to, by pointers twice as long every round. A
    form has twice the occurrences, so a chain has no cycle and few steps."""
    spark = forms.sparkSession
    current = forms.select("id", F.col("form_id").alias("root"))
    while True:
        path = new_path(spark, "roots")
        current.write.parquet(path)
        current = spark.read.parquet(path)
        step = current.alias("a").join(
            current.select(F.col("id").alias("at"), F.col("root").alias("far")).alias("b"),
            F.col("a.root") == F.col("b.at"), "left")
        if step.filter("far IS NOT NULL").limit(1).count() == 0:
            return current
        current = step.select("id", F.coalesce("far", "root").alias("root"))


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3,
                      damage_every: int = 0, ratio: int = 2) -> DataFrame:
    """Every word of the texts with its ``n``, its number of near words ``n_near``, the ``form`` it
    is a variant of (the near word of largest n, if that is ``ratio`` times its own or more), that
    word's ``form_n``, and the ``root`` its forms lead to."""
    spark = docs.sparkSession
    path = new_path(spark, "words")
    count_words(docs, min_chars, min_count, damage_every).write.parquet(path)
    numbered, near = near_words(spark.read.parquet(path))
    near = near.withColumnRenamed("id", "near_id")
    path = new_path(spark, "near")
    numbered.join(near, F.col("id") == F.col("near_id"), "left").withColumn(
        "form_id", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.id"))).select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_id",
        F.when(F.col("form_id").isNotNull(), -F.col("best.less")).alias("form_n")) \
        .write.parquet(path)
    found = spark.read.parquet(path)
    roots = _last_of_chain(found.filter("form_id IS NOT NULL"))
    names = found.select(F.col("id").alias("to"), F.col("word").alias("name"))
    out = found.join(roots.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    out = out.join(names.withColumnRenamed("name", "form"), F.col("form_id") == F.col("to"),
                   "left").drop("to")
    out = out.join(names, F.col("root") == F.col("to"), "left")
    return out.select("word", "form", F.coalesce("name", "word").alias("root"), "n", "n_near",
                      "form_n")
