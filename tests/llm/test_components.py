"""Connected components against a union-find, on chains, stars, cycles and random links."""

import random

from scholia.llm.common import components


def _brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(999, i) for i in range(200, 230)] + [(300, 999)]
    cycle = [(i, 500 + (i - 499) % 9) for i in range(500, 509)]
    loose = [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    links = chain + star + cycle + loose + [(1, 1), (None, 3), (4, None), (201, 999)]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: r["root"] for r in got} == _brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
