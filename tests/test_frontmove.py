"""Move-to-front lists against one list that is changed token by token."""

import random
import re

import pytest

from tessera.operators import frontmove as M


def plain(tokens, symbols):
    own, out = list(range(symbols)), []
    for t in tokens:
        v = own[t] if t is not None and 0 <= t < symbols else None
        if v is not None:
            own.remove(v)
            own.insert(0, v)
        out.append(v)
    return out


@pytest.mark.parametrize("block,fan,symbols", [(4096, 512, 256), (5, 3, 7), (1, 2, 4)])
def test_blocks_and_levels(spark, block, fan, symbols):
    r, rows, expected = random.Random(1), [], {}
    for owner, n in (("a", 200), ("b", 1), (None, 37), ("d", 16)):
        tokens = [r.choice([0, r.randrange(symbols), r.randrange(symbols), None, symbols]) for _ in range(n)]
        rows += [(owner, k, t, "extra") for k, t in enumerate(tokens)]
        expected |= {(owner, k): v for k, v in enumerate(plain(tokens, symbols))}
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "owner string, place int, v int, start string").repartition(3)
    assert {(x.owner, x.place): x.v for x in M.undone(table, symbols=symbols, block=block, fan=fan).collect()} == expected
    assert M.undone(table.where("false")).count() == 0


def test_clusters_without_holes(spark):
    table = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", 0), ("b", 2), ("c", 1)], "owner string, v int")
    assert {tuple(r) for r in M.is_dense(table).collect()} == {("a", 2, True), ("b", 3, False), ("c", 2, False)}


def test_blocks_follow_each_other_in_a_stream(spark):
    """Short blocks are not a call of Python each."""
    table = spark.range(100).selectExpr("id % 3 AS owner", "id AS place", "id % 7 AS v")
    plan = M.undone(table, block=16, fan=4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"(?<!\w)MapInArrow", plan) and not re.search(r"FlatMapGroupsInArrow \[owner#\d+, block", plan)
