"""Repairs of conversations against a plain search over single edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.conversations import damage, plan_repair, repair_report, repaired_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(name.encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (2 if h == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        if not said:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, fault):
    """Cheapest edits by a search over (rows done, initials so far folded to a state)."""
    def step(state, c):  # state: what the initials end in
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a",
                ("a", "u"): "u"}.get((state, c))

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        if at == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        done.add((at, state))
        for c, name in (("u", "user"), ("a", "assistant")):
            to = step(state, c)
            if to is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", at, to, (*lines, f"{name}:")))
        if at == len(rows):
            continue
        _, _, role, text = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, lines))
        if fault[at] in ("blank", "duplicate"):
            continue
        more = 5 if fault[at] == "truncated" else 0
        to = step(state, role[:1])
        if to is not None:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*lines, f"{role}:{text}")))
        for c, name in (("u", "user"), ("a", "assistant")):
            to = step(state, c)
            if to is not None:
                heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, to,
                                      (*lines, f"{name}:{text}")))


def plain_report(rows):
    """Of the rows of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2],
                                       hashlib.sha256(r[3].encode()).hexdigest()))
    fault = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, body = plain_repair(rows, fault)
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost,
            audit, hashlib.sha256(body.encode()).hexdigest())


def report(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                       r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv_id in conversations:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv_id, rng.choice((turn, turn, turn, turn + 1, None)),
                         rng.choice(("user", "assistant", "assistant", "user", "system", "tool", "",
                                     None, "User")),
                         rng.choice(("Yes.", "No", "Why?", "", " \n", None, f"Turn {turn}.",
                                     "Ends. \n", f"Cut {turn}", "é!"))))
    return rows


def grouped(rows, ids):
    return {i: plain_report([r for r in rows if r[0] == i]) for i in ids}


@pytest.mark.parametrize("seed, ids, longest", [(1, [*range(60), None], 9), (2, [1, 2, None], 40)])
def test_against_a_search(spark, seed, ids, longest):
    rows = random_rows(seed, ids, longest)
    talks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    damaged = damage(talks)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, damaged.collect()), key=key) == sorted(plain_damage(rows), key=key)
    want = grouped(plain_damage(rows), {r[0] for r in rows})
    got = report(repair_report(talks, damaged))
    assert got == want


def test_one_conversation_over_chunks_and_tasks(spark):
    """A conversation of many chunks, over several tasks of the sort, beside short ones."""
    rows = plain_damage(random_rows(3, [7], 1)) + [
        (9, t, random.Random(t).choice(("user", "assistant", "system", "tool")),
         random.Random(-t).choice((f"{t}.", f"{t}", "", "same.")) ) for t in range(700)]
    rows += [(9, 5000, "user", "again.")] * 150
    talks = spark.createDataFrame(rows, SCHEMA)
    assert plan_repair(talks).filter("conv_id = 9").count() > 10
    assert report(repair_report(talks, talks)) == grouped(rows, {r[0] for r in rows})


def test_repaired_rows_follow_the_grammar(spark):
    rows = plain_damage(random_rows(4, range(40), 12))
    talks = spark.createDataFrame(rows, SCHEMA)
    told = {}
    for r in sorted(repaired_rows(talks, plan_repair(talks)).collect(),
                    key=lambda r: (r.conv_id, r.position)):
        told.setdefault(r.conv_id, []).append(r)
    assert all(GRAMMAR.fullmatch("".join(r.role[0] for r in x)) for x in told.values())
    assert any(r.action == "I" for x in told.values() for r in x) or len(told) > 20


def test_odd_tables(spark):
    """No rows left, no rows at all, long texts, columns named like those within."""
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (gone + 1000, 3, "user", "x" * 200_000 + "."),
            (gone + 1000, 4, "assistant", "y" * 200_000), (None, None, None, None)]
    talks = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn(
        "n", F.lit(1)).withColumn("digest", F.lit("d"))
    got = report(repair_report(talks, damage(talks)))
    want = grouped(plain_damage(rows), {r[0] for r in rows})
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_report(talks.limit(0), damage(talks.limit(0))).collect() == []
