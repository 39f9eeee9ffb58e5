import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators.graph import CycleError, circular_core, climb, components, ranked


def test_components(spark):
    r = random.Random(1)
    edges = [(f"n{r.randint(0, 300):03}", f"n{r.randint(0, 300):03}") for _ in range(200)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_climb(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", None)]
    assert sorted(map(tuple, climb(spark.createDataFrame(rows, "node string, parent string")).collect())) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)]
    with pytest.raises(CycleError):
        climb(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))
    some = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None), ("e", "d")], "node string, parent string")
    assert sorted(map(tuple, climb(some, strict=False).collect())) == [("d", "d", 0), ("e", "d", 1)]


def test_core_keeps_all_cycles(spark):
    r = random.Random(3)
    for k in (0, 2, 4):
        n = 60
        edges = {(f"n{a:02}", f"n{b:02}") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(40 + 10 * k)) if a != b}
        reach = {}
        for a, b in edges:
            reach.setdefault(a, set()).add(b)

        def below(x):
            seen, stack = set(), [x]
            while stack:
                for y in reach.get(stack.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            return seen

        core, count = circular_core(spark.createDataFrame(sorted(edges), "a string, b string"))
        kept = {tuple(x) for x in core.collect()}
        on_cycles = {(a, b) for a, b in edges if a in below(b)}
        assert on_cycles <= kept <= edges and len(kept) == count and (on_cycles or not kept or k > 3)


def test_ranks_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), i) for i in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, v long")
    small, large = (sorted(ranked(df, ["g"], [F.col("v")], "n", large=most).select("g", "v", "n").collect(), key=str) for most in (1000, 10))
    assert [tuple(x) for x in small] == [tuple(x) for x in large]
