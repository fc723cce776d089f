import random

import pytest

from lavra.llm.chains import jump_pointers, previous_rows
from lavra.llm.graph import connected_components


def test_pointer_jumping_finds_roots_orphans_and_cycles(spark):
    rows = [(1, None, 1), (2, 1, 1), (3, 2, 0), (4, 3, 1), (5, 9, 1), (6, 5, 1), (7, 8, 1), (8, 7, 1), (10, 7, 1), (11, 11, 1), (None, 1, 1)]
    got = {tuple(r) for r in jump_pointers(spark.createDataFrame(rows, "id long, parent long, weight int")).collect()}
    assert got == {
        (1, 1, 1, "ok"), (2, 1, 2, "ok"), (3, 1, 2, "ok"), (4, 1, 3, "ok"), (5, 5, 1, "orphan"), (6, 5, 2, "orphan"),
        (7, None, None, "cycle"), (8, None, None, "cycle"), (10, None, None, "cycle"), (11, None, None, "cycle"),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_long_chains(spark, n):
    chain = spark.range(n).selectExpr("id", "nullif(id - 1, -1) as parent", "1 as weight")
    got = {r.id: (r.root, r.depth) for r in jump_pointers(chain).collect()}
    assert got == {i: (0, i + 1) for i in range(n)}


def test_empty_tables(spark):
    assert jump_pointers(spark.createDataFrame([], "id long, parent long, weight int")).count() == 0
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_previous_rows_across_partitions(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}", rng.choice([None, *range(30)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, id long").repartition(7)
    got = {r.id: r.prev_id for r in previous_rows(df, "g", ["t", "id"], ["id"]).collect()}
    last, expected = {}, {}
    for g, t, i in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        expected[i] = last.get(g)
        last[g] = i
    assert got == expected


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
