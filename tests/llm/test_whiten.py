import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotflow.llm.queries import QUERIES
from spotflow.llm.whiten import OFFSET, STEP, by_component, deviations, fit, whitened, whole_numbers

SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened int"


def brute(rows):
    """Kept rows and, for them, whole numbers, eigenvalues and components, by loops and numpy's own covariance."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(STEP * float(np.float32(c))) + OFFSET for c in v] for _, v in kept]
    n = len(x)
    totals = [sum(r[d] for r in x) for d in range(len(x[0]))]
    exact = [sum((n * e - s) ** 2 for e, s in zip(r, totals)) for r in x]
    values, vectors = np.linalg.eigh(np.cov(np.array(x, float).T, bias=True))
    return [k for k, _ in kept], np.array(x, float), totals, exact, values[::-1], vectors[:, ::-1]


def make(n, dims, seed):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims))
    return [(i, [float(c) for c in row]) for i, row in enumerate(mixed)]


def test_against_numpy(spark):
    rows = make(300, 9, 1)
    rows += [(900, None), (901, [1.0] * 8 + [None]), (902, [1.0] * 8 + [float("nan")]), (903, [float("inf")] + [0.0] * 8), (None, rows[0][1]), (5, rows[5][1]), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(k, v, None, "kept", 7) for k, v in rows], SCHEMA).repartition(3)
    ids, x, totals, exact, values, vectors = brute([r for r in rows if r[0] not in (904, 905)])
    made = whitened(df, most=4)
    assert made.columns == ["vec_id", "label", "n", "deviation", "whitened", "explained", "identity_error"]
    got = made.collect()
    key = lambda k: (k is None, k or 0)
    assert sorted((r.vec_id for r in got), key=key) == sorted(ids, key=key)
    assert sorted(r.deviation for r in got) == sorted(exact) and {r.n for r in got} == {len(ids)}
    want = {k: (x[i] - np.array(totals) / len(ids)) @ vectors[:, :4] / np.sqrt(values[:4]) for i, k in enumerate(ids)}
    sign = np.sign(np.array(got[0].whitened) * want[got[0].vec_id])
    for r in got:
        assert np.allclose(r.whitened, want[r.vec_id] * sign, atol=1e-8)
        assert np.allclose(r.explained, values[:4] / values.sum(), rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    long = by_component(made).collect()
    assert len(long) == 4 * len(ids) and {r.component for r in long} == {1, 2, 3, 4}


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitened(df).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    same = whitened(df.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))).collect()
    assert len(same) == 20 and all(r.whitened == [] and r.deviation == 0 and r.n == 20 and r.identity_error == 0 for r in same)


def test_empty_tables_and_one_row(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [None])]):
        made = whitened(spark.createDataFrame(rows, kind))
        assert made.collect() == [] and by_component(made).collect() == []
    one = whitened(spark.createDataFrame([(1, [0.5, 2.0])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(1, 0, [])]


def test_deviations_beyond_a_long():
    rng = random.Random(3)
    x = np.array([[rng.randint(0, 1 << 50) for _ in range(3)] for _ in range(9)] + [[1, 2, 3]], np.int64)
    totals = [1, 2, 3]
    for n in (1, 1 << 5, 1 << 20):
        want = [sum((n * e - s) ** 2 for e, s in zip(map(int, r), totals)) for r in x]
        assert deviations(x, n, totals) == [w if w < 1 << 63 else None for w in want]


def test_large_entries_are_not_finite(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1.0, 2.0]), (3, [-3.5, 0.25])], "vec_id long, embedding array<double>")
    held, columns = whole_numbers(df, "embedding")
    assert sorted(tuple(r[c] for c in columns) for r in held.collect()) == [(999776, 1000016), (1000064, 1000128)]
    assert fit(held, columns)["n"] == 2


def test_query(spark):
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    ids, x, totals, exact, values, vectors = brute(rows)
    assert len(got) == 32 * len(ids)
    place = {k: i for i, k in enumerate(ids)}
    w = np.zeros((len(ids), 32))
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == exact[place[r.vec_id]] and r.n == len(ids)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-6 and got[0].identity_error < 1e-6
    want = (x - np.array(totals) / len(ids)) @ vectors[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs((w * want).mean(axis=0)) - 1).max() < 1e-6
