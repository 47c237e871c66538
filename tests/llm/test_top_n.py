import random
from collections import defaultdict

import pytest

from anchorline.llm import top_n as module
from anchorline.llm.top_n import top_n


def brute(data, n):
    by = defaultdict(set)
    for g, h, s, t in data:
        if s is not None and t is not None:
            by[g, h].add((-s, t))
    return {(g, h, -s, t) for (g, h), own in by.items() for s, t in sorted(own)[:n]}


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(module, "CHUNK", 50)
        monkeypatch.setattr(module, "KEEP", 40)
    r = random.Random(4)
    data = [(r.choice(["hot"] * 5 + ["a", "b", None]), r.choice(["x", "y", None]), r.choice([None, *range(15)]), r.choice([None, *range(200)])) for _ in range(3000)]
    data += data[:500]
    df = spark.createDataFrame(data, "g string, h string, s bigint, t bigint").repartition(5)
    got = {(x.g, x.h, x.s, x.t) for x in top_n(df, ["g", "h"], "s", "t", 3).collect()}
    assert got == brute(data, 3)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, 1)], "g string, s bigint, t bigint")
    assert top_n(df.limit(0), ["g"], "s", "t", 3).count() == 0
    assert [tuple(x) for x in top_n(df, ["g"], "s", "t", 3).collect()] == [("a", 1, 1, 1)]
    with pytest.raises(ValueError):
        top_n(df, ["g"], "s", "t", 0)


def test_bounds_of_many_small_tasks(spark):
    """Every task holds a part of every group, null groups included; the bounds of all of them leave the same rows as a plain ranking."""
    rows = [(None if i % 7 == 0 else f"g{i % 5}", (i * 37) % 101, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s bigint, t bigint").repartition(9)
    got = {(r.g, r.s, r.t, r["rank"]) for r in top_n(df, ["g"], "s", "t", 4).collect()}
    want = set()
    for g in {g for g, _, _ in rows}:
        best = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:4]
        want |= {(*x, i) for i, x in enumerate(best, 1)}
    assert got == want
