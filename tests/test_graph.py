import random

import pytest

from spotflow.graph import components


def expected(edges):
    root = {}

    def top(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {k: top(k) for k in root}


@pytest.mark.parametrize("few", [0, 5, 1 << 14])
def test_components(spark, few):
    rng = random.Random(few)
    edges = [(k, k + 1) for k in range(-40, 0)] + [(rng.randint(100, 260), rng.randint(100, 260)) for _ in range(90)] + [(7, 7), (300, 300), (1 << 62, -(1 << 62))]
    edges += [(b, a) for a, b in edges[:20]] * 2
    df = spark.createDataFrame([*edges, (None, 5), (5, None)], "a long, b long").repartition(3)
    got = components(df, few).collect()
    assert {r.node: r.label for r in got} == expected(edges) and len(got) == len(expected(edges))


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(None, None)], "a long, b long"), 0).collect() == []
