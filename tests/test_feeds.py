"""Lines of an order numbered in one window or, if it is large, in two levels."""

import random
from collections import Counter, defaultdict

import pytest

from tidemark.plans import feeds

SCHEMA = ("l_orderkey bigint, l_shipdate date, l_linenumber int, l_partkey bigint, l_suppkey bigint")


def made(spark):
    rng = random.Random(3)
    rows = [(key, None, n, part, 1) for key, count in [(1, 40), (2, 3), (None, 30), (4, 1)]
            for n, part in [(rng.choice([None, 1, 2]), rng.randrange(500)) for _ in range(count)]]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("most", [1, 20, 1000])
def test_lines_are_numbered_whatever_is_large(spark, monkeypatch, most):
    monkeypatch.setattr(feeds, "MOST_LINES", most)
    rows, lines = made(spark)
    by_order = defaultdict(list)
    for r in rows:
        by_order[r[0]].append(r)
    want = Counter()
    for group in by_order.values():
        group.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[3]))
        want.update((*r, k) for k, r in enumerate(group, 1))
    out = feeds.line_ranks(lines)
    assert Counter(tuple(r) for r in out.select(*lines.columns, "rank").collect()) == want
    assert dict(out.dtypes)["rank"] == "bigint"


def test_lines_of_ordinary_orders_are_exchanged_once(spark):
    out = feeds.line_ranks(made(spark)[1])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Window ") == 1 and plan.count(" Sort ") == 1
