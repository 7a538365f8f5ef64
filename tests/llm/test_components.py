"""Connected components against union-find."""

import random

import pytest

from quern.llm.components import components
from quern.llm.near_copies import _joined
from quern.session import stored

PAIRS = "a long, b long"


def union_find(links):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in up)


def rows(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("n", [0, 120])
def test_components_and_later_links(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(n)]
    links += [(i, i + 1) for i in range(1000, 1000 + n // 4)] + [(5, 5), (None, 3)]
    later = [(rng.randrange(-250, 250), rng.randrange(-250, 250)) for _ in range(40)]
    known = stored(components(spark.createDataFrame(links, PAIRS)), "test-known")
    assert rows(known) == union_find(links)
    assert rows(_joined(known, spark.createDataFrame(later, PAIRS))) == union_find(links + later)
    assert rows(_joined(known, spark.createDataFrame([], PAIRS))) == union_find(links)
