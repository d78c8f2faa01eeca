"""Whitening of embeddings: upper-triangle column aggregates, one covariance, LAPACK.

Entries become whole numbers, each dimension a column. One aggregation has the sums of all dimensions, a second
one a generated expression for every pair of dimensions: the sum of their products, centred before they are
multiplied. The covariance that these make is decomposed by LAPACK, and tasks project their rows on its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, send

#: A whole number is floor(STEP * entry) + OFFSET; entries so large that a double has no such numbers count as not finite.
STEP, OFFSET, LARGEST = 64, 1_000_000, float(1 << 53)
#: Components whose eigenvalue is below this share of the largest one are rounding, not variance.
FLAT = 1e-12


def whole_numbers(df: DataFrame, vector: str) -> tuple[DataFrame, list[str]]:
    """df with a column of whole numbers for each dimension, without rows whose vector is no finite one, and these columns' names.

    The dimension is the commonest length of such vectors, of two as common the longer one: a vector of another
    length has entries that are missing. Without any vector there are no columns.
    """
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * STEP) < LARGEST, F.lit(False)))
    held = df.where(finite)
    sizes = held.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes or not sizes[0]["size"]:
        return held.where("false"), []
    names = [free_name(df, f"_x{k}") for k in range(sizes[0]["size"])]
    columns = {n: (F.floor(F.get(vector, F.lit(k)).cast("double") * STEP) + OFFSET).cast("long") for k, n in enumerate(names)}
    return held.where(F.size(vector) == len(names)).withColumns(columns), names


def sums(df: DataFrame, columns: list[str]) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each column, in one aggregation."""
    row = df.agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(f"s{k}") for k, c in enumerate(columns))).first()
    return int(row[0]), [int(s or 0) for s in row[1:]]


def covariance(df: DataFrame, columns: list[str], means: list[float], n: int) -> np.ndarray:
    """Covariance of columns, divisor n: a sum for each pair of the upper triangle, all in one aggregation.

    Columns hold no nulls; that Spark is told so halves the aggregation's time.
    """
    centred = df.selectExpr(*(f"coalesce(CAST(`{c}` AS DOUBLE) - CAST('{m!r}' AS DOUBLE), 0D) AS c{k}" for k, (c, m) in enumerate(zip(columns, means, strict=True))))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = centred.agg(*(F.expr(f"sum(c{i} * c{j})").alias(f"s{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), s in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = (s or 0.0) / n
    return out


def fit(held: DataFrame, columns: list[str], most: int = 32) -> dict | None:
    """Sums, components (columns of unit length, by falling eigenvalue) and eigenvalues; None without rows or variance.

    At most `most` components, and none without variance: a constant vector set has none.
    """
    if not columns:
        return None
    n, totals = sums(held, columns)
    if not n:
        return None
    cov = covariance(held, columns, [s / n for s in totals], n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:most]
    order = order[values[order] > max(values[order[0]], 0.0) * FLAT]
    if not len(order):
        return None
    return {"n": n, "sums": totals, "values": values[order], "vectors": vectors[:, order], "trace": float(np.trace(cov))}


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exactly; None where that is no long."""
    big = 1 << 63
    # x and n may be so large that int64 wraps round: doubles tell which rows can
    rough = ((x.astype(float) * n - np.array(totals, float)) ** 2).sum(axis=1)
    safe = (rough < 2.0**62) & (np.abs(x).max(axis=1).astype(float) * n < 2.0**62) & (max(map(abs, totals)) < 1 << 62)
    out: list[int | None] = [None] * len(x)
    d = x[safe] * np.int64(n) - np.array(totals, np.int64) if safe.any() else np.zeros((0, x.shape[1]), np.int64)
    for i, value in zip(np.flatnonzero(safe), (d * d).sum(axis=1).tolist(), strict=True):
        out[i] = value
    for i in np.flatnonzero(~safe):
        value = sum((n * int(e) - s) ** 2 for e, s in zip(x[i].tolist(), totals, strict=True))
        out[i] = value if value < big else None
    return out


def projected(held: DataFrame, columns: list[str], model: dict) -> DataFrame:
    """held's other columns, deviation and whitened: an array of a coordinate for each component."""
    others = [c for c in held.columns if c not in columns]
    size = len(columns)
    sent = send(held.sparkSession, model)  # a square of the dimension at most
    packed = held.select(*others, F.array(*columns).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value[1]
        mean = np.array([s / m["n"] for s in m["sums"]])
        turn = m["vectors"] / np.sqrt(m["values"])
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            made = (x.astype(float) - mean) @ turn
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1], pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(deviations(x, m["n"], m["sums"]), pa.int64()), lists], [*others, "deviation", "whitened"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*others).schema), "deviation long, whitened array<double>"])
    return map_rows(packed, run, schema)


def whitened(df: DataFrame, vector: str = "embedding", most: int = 32) -> DataFrame:
    """Every column of df but vector, then n, deviation, whitened (array, a coordinate a component), explained (array) and identity_error.

    Rows whose vector is null, holds null or entries that aren't finite (or are of 2**47 and more, for which no
    whole number is exact), or is of another length than most, are dropped. Components are those of the
    remaining vectors' covariance, by falling eigenvalue, `most` at most and only those with variance: equal
    vectors have none, and give empty arrays and an identity_error of 0. Repeated rows stay and count. A deviation
    that is no long is null. identity_error is measured: the largest absolute entry of the covariance of what
    the rows became, minus the identity. Columns with a result's name are replaced. df is read five times.
    """
    results = ("n", "deviation", "whitened", "explained", "identity_error")
    base = df.select(*[c for c in df.columns if c not in results])
    held, columns = whole_numbers(base, vector)
    held = held.drop(vector)
    model = fit(held, columns, most)
    if model is None:
        n, totals = sums(held, columns) if columns else (0, [])
        model = {"n": n, "sums": totals, "values": np.ones(0), "vectors": np.zeros((len(columns), 0)), "trace": 1.0}
        if not n:
            kept = held.drop(*columns)
            return kept.select("*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"), F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    made = projected(held, columns, model)
    parts = len(model["values"])
    error = 0.0
    if parts:
        flat = made.select(*(F.get("whitened", F.lit(k)).alias(f"w{k}") for k in range(parts)))
        means = [float(m) for m in flat.agg(*(F.avg(c) for c in flat.columns)).first()]
        error = float(np.abs(covariance(flat, flat.columns, means, model["n"]) - np.eye(parts)).max())
    shares = F.array(*(F.lit(float(v / model["trace"])) for v in model["values"])).cast("array<double>")
    kept = [c for c in made.columns if c not in ("deviation", "whitened")]
    return made.select(*kept, F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(made: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row for each row of whitened() and each of its components: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = made.select(key, "n", "deviation", "identity_error", pairs.alias("at", "pair"))
    return rows.select(key, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
