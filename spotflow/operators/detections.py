"""Operators on detections as plain DataFrame expressions: close pairs, filters, ranks, link edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spacetime import near_counts, near_pairs
from ..storage import forget, stored


def with_cells(points: DataFrame, size: float, y: str, x: str, spread: bool) -> DataFrame:
    """Grid cell of side `size`; with spread, a copy of each row for the nine cells round it."""
    cy, cx = F.floor(F.col(y) / size), F.floor(F.col(x) / size)
    if not spread:
        return points.withColumns({"_cy": cy, "_cx": cx})
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return points.withColumn("_s", F.explode(steps)).withColumns({"_cy": cy + F.col("_s.a"), "_cx": cx + F.col("_s.b")}).drop("_s")


def suppress_close(points: DataFrame, separation: float, by: list[str], order: str, y: str = "y", x: str = "x", mass: str = "mass") -> DataFrame:
    """Without points that have a neighbour nearer than separation with more mass, or as much and first in order.

    One pass: a point that goes still suppresses others. The grid cell is part of the join's key, so a
    crowded frame is compared within neighbourhoods.
    """
    left = with_cells(points, separation, y, x, spread=False).alias("l")
    other = with_cells(points.select(*by, order, y, x, mass), separation, y, x, spread=True).alias("r")
    c = lambda side, name: F.col(f"{side}.{name}")
    near = (c("l", y) - c("r", y)) * (c("l", y) - c("r", y)) + (c("l", x) - c("r", x)) * (c("l", x) - c("r", x)) < separation * separation
    beats = (c("r", mass) > c("l", mass)) | ((c("r", mass) == c("l", mass)) & (c("r", order) < c("l", order)))
    same = [c("l", k) == c("r", k) for k in (*by, "_cy", "_cx")]
    on = near & beats & (c("l", order) != c("r", order))
    for s in same:
        on = on & s
    return left.join(other, on, "left_anti").drop("_cy", "_cx")


def places(points: DataFrame, by: list[str], order: str, frame: str = "frame", y: str = "y", x: str = "x") -> DataFrame:
    """by, frame, y, x, place (least of order), n of each position that detections of a frame have; null, NaN and infinite ones are nowhere."""
    held = points.where((F.abs(y) < float("inf")) & (F.abs(x) < float("inf")))
    return held.groupBy(*by, F.col(frame).alias("frame"), F.col(y).alias("y"), F.col(x).alias("x")).agg(F.min(order).alias("place"), F.count("*").alias("n"))


def place_edges(points: DataFrame, search_range: float, by: list[str], order: str, frame: str = "frame", y: str = "y", x: str = "x") -> DataFrame:
    """by, frame (of the later one), src, dst, n_src, n_dst, d2: places of neighbouring frames nearer than search_range.

    A place stands for all its detections, which place_members() lists, so copies add nothing to the pairs.
    """
    held = places(points, by, order, frame, y, x)
    kind = held.schema["place"].dataType.simpleString()

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        at, target, places_at = _block_places(rows)
        place, many = rows.column("place").combine_chunks(), rows.column("n").to_numpy()
        for t in np.unique(at[target]).tolist():
            src, dst = np.flatnonzero(at == t - 1), np.flatnonzero((at == t) & target)
            for i, j, d2 in near_pairs(places_at[src], places_at[dst], search_range, EDGES_AT_ONCE):
                ends = [place.take(pa.array(src[i])), place.take(pa.array(dst[j])), pa.array(many[src[i]]), pa.array(many[dst[j]])]
                yield pa.RecordBatch.from_arrays([*_same_block(rows, by, t, len(i)), *ends, pa.array(d2)], [*by, "frame", "src", "dst", "n_src", "n_dst", "d2"])

    known = held.withColumnsRenamed({"y": "_y", "x": "_x"}).withColumns({"_y": F.col("_y").cast("double"), "_x": F.col("_x").cast("double")})
    return _by_blocks(known, search_range, by, False, pairs_of, f"src {kind}, dst {kind}, n_src long, n_dst long, d2 double")


def place_members(points: DataFrame, by: list[str], order: str, frame: str = "frame", y: str = "y", x: str = "x") -> DataFrame:
    """points with place: the least of order at their position; null where a detection is nowhere."""
    held = places(points, by, order, frame, y, x).drop("n").withColumnsRenamed({"frame": "_f", "y": "_y", "x": "_x", **{b: f"_b{k}" for k, b in enumerate(by)}})
    on = [F.col(frame) == F.col("_f"), F.col(y) == F.col("_y"), F.col(x) == F.col("_x"), *(F.col(b).eqNullSafe(F.col(f"_b{k}")) for k, b in enumerate(by))]
    return points.join(held, on, "left").select(*points.columns, "place")


def link_degrees(points: DataFrame, search_range: float, by: list[str], order: str, frame: str = "frame", y: str = "y", x: str = "x") -> DataFrame:
    """points with n_before and n_after: how many detections of the frame before and of the one behind are in range.

    Counted place by place in blocks of frames and space, see near_counts(): no edge is ever made, and each point meets its place's counts once.
    """
    known = places(points, by, order, frame, y, x).drop("place").withColumnsRenamed({"y": "_y", "x": "_x"}).withColumns({"_y": F.col("_y").cast("double"), "_x": F.col("_x").cast("double")})

    def counts_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        at, target, places_at = _block_places(rows)
        many = rows.column("n").to_numpy()
        for t in np.unique(at[target]).tolist():
            own = np.flatnonzero((at == t) & target)
            sides = [pa.array(near_counts(places_at[there], many[there], places_at[own], search_range, EDGES_AT_ONCE)) for there in (np.flatnonzero(at == t - 1), np.flatnonzero(at == t + 1))]
            yield pa.RecordBatch.from_arrays([*_same_block(rows, by, t, len(own)), pa.array(places_at[own, 0]), pa.array(places_at[own, 1]), *sides], [*by, "frame", "_y", "_x", "_before", "_after"])

    counts = _by_blocks(known, search_range, by, True, counts_of, "_y double, _x double, _before long, _after long")
    counts = counts.withColumnsRenamed({"frame": "_f", **{b: f"_b{k}" for k, b in enumerate(by)}})
    on = [F.col(frame) == F.col("_f"), F.col(y).cast("double") == F.col("_y"), F.col(x).cast("double") == F.col("_x"), *(F.col(b) == F.col(f"_b{k}") for k, b in enumerate(by))]
    named = points.join(counts, on, "left")
    return named.select(*points.columns, F.coalesce("_before", F.lit(0)).alias("n_before"), F.coalesce("_after", F.lit(0)).alias("n_after"))


#: A task looks for edges in blocks of so many frames, and of so many search ranges each way; it hands on about so many edges at a time.
EDGE_FRAMES, EDGE_RANGES, EDGES_AT_ONCE = 2, 8, 1 << 17


def _block_places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame, whether the block is the place's own, and y, x of a block's rows."""
    return rows.column("frame").to_numpy(), rows.column("_target").to_numpy(), np.stack([rows.column("_y").to_numpy(), rows.column("_x").to_numpy()], axis=1)


def _same_block(rows: pa.Table, by: list[str], t: int, n: int) -> list[pa.Array]:
    """by of the block and frame t, n times."""
    few = rows.slice(0, 1).select(by).take(np.zeros(n, np.int64)) if by else None
    return [*(few.column(b).combine_chunks() for b in by), pa.array(np.full(n, t), rows.schema.field("frame").type)]


def _by_blocks(known: DataFrame, search_range: float, by: list[str], both: bool, found: Callable[[pa.Table], Iterator[pa.RecordBatch]], columns: str) -> DataFrame:
    """by, frame and columns: what found() makes of each block of known(by, frame, _y, _x, ...), places of finite positions.

    A block's rows are its own places (_target) and those of the frame before, with both also of the one behind, that may be in range of one.
    """
    side, reach, f = search_range * EDGE_RANGES, search_range * (1 + 1e-9), F.col("frame")
    known = known.where(reduce(lambda p, q: p & q, (F.col(b).isNotNull() for b in (*by, "frame"))))
    own = F.struct(F.floor(f / EDGE_FRAMES).alias("t"), F.floor(F.col("_y") / side).alias("y"), F.floor(F.col("_x") / side).alias("x"))
    # where the frame behind (or before) and what is in reach may be; three at a side where a detection is as far as doubles are coarse
    beside = [F.floor((F.col(c) + d) / side) for c in ("_y", "_x") for d in (-reach, reach)]
    times = [F.floor((f + d) / EDGE_FRAMES) for d in ((1, -1) if both else (1,))]
    ys, xs = (beside[0], F.floor(F.col("_y") / side), beside[1]), (beside[2], F.floor(F.col("_x") / side), beside[3])
    there = F.array_distinct(F.array(own, *(F.struct(t.alias("t"), a.alias("y"), b.alias("x")) for t in times for a in ys for b in xs)))
    dealt = known.withColumn("_own", own).withColumn("_at", F.explode(there)).withColumn("_target", F.col("_own") == F.col("_at"))
    keys = [*by, "_bt", "_by", "_bx"]
    rows = dealt.select(*known.columns, F.col("_at.t").alias("_bt"), F.col("_at.y").alias("_by"), F.col("_at.x").alias("_bx"), "_target")
    kinds = {c.name: c.dataType.simpleString() for c in known.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after the other; the last one of a batch waits until it is complete."""
        held: list[pa.Table] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                ends = [held[0].slice(0, 1).select(keys).to_pylist(), batch.slice(batch.num_rows - 1).select(keys).to_pylist()]
                if ends[0] == ends[1]:
                    continue
            if held and (batch is None or batch.num_rows):
                rows = pa.concat_tables(held)
                change = np.zeros(rows.num_rows, bool)
                for k in keys:
                    column = rows.column(k).combine_chunks()
                    change[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
                begin = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
                for a, b in zip(begin, begin[1:] if batch is None else begin[1:-1]):
                    yield from found(rows.slice(a, b - a))
                held = [] if batch is None else [rows.slice(begin[-2])]

    session = known.sparkSession
    parts = min(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)  # a number, as few bytes make many edges
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"frame {kinds['frame']}, {columns}"])
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def link_edges(points: DataFrame, search_range: float, by: list[str], order: str, frame: str = "frame", y: str = "y", x: str = "x") -> DataFrame:
    """by, frame (of the later one), src, dst, d2: pairs of detections of neighbouring frames nearer than search_range.

    Every edge is a row. A place travels with its detections to its block, and to those behind and beside it only if it may hold sources
    there; a task makes the edges of a block in passing, some at a time, so disk grows with the detections. place_edges() has the same in less.
    """
    finite = (F.abs(y) < float("inf")) & (F.abs(x) < float("inf"))
    known = points.where(finite).groupBy(*by, F.col(frame).alias("frame"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")).agg(F.collect_list(order).alias("_ids"))
    kind = points.schema[order].dataType.simpleString()

    def edges_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = rows.column("_ids").combine_chunks()
        unit = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())  # the place of each detection
        at, target, places_at = (c[unit] for c in _block_places(rows))
        ids = lists.flatten()
        for t in np.unique(at[target]).tolist():
            src, dst = np.flatnonzero(at == t - 1), np.flatnonzero((at == t) & target)
            for i, j, d2 in near_pairs(places_at[src], places_at[dst], search_range, EDGES_AT_ONCE):
                made = [*_same_block(rows, by, t, len(i)), ids.take(pa.array(src[i])), ids.take(pa.array(dst[j])), pa.array(d2)]
                yield pa.RecordBatch.from_arrays(made, [*by, "frame", "src", "dst", "d2"])

    return _by_blocks(known, search_range, by, False, edges_of, f"src {kind}, dst {kind}, d2 double")


def trivial_links(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges whose ends have no other edge: final whatever the rest does."""
    ends = lambda side: Window.partitionBy(*by, "frame", side)
    counted = edges.withColumns({"_s": F.count("*").over(ends("src")), "_d": F.count("*").over(ends("dst"))})
    return counted.where("_s = 1 AND _d = 1").drop("_s", "_d")


def sole_links(points: DataFrame, search_range: float, by: list[str], order: str, frame: str = "frame", y: str = "y", x: str = "x") -> DataFrame:
    """by, frame, src, dst: the trivial_links() of link_edges(), without making the edges.

    Detections of one place are one row with their number. A detection that shares a small cell with two of
    the other frame has no sole link (any two points of such a cell are in range), so only the others are
    compared with their neighbourhoods, and of these comparisons only counts leave a task.
    """
    keys = [*by, frame]
    held = points.groupBy(*keys, F.col(y).alias("_y"), F.col(x).alias("_x")).agg(F.count("*").alias("_n"), F.min(order).alias("_id"))
    places = stored(held.where("abs(_y) < double('inf') AND abs(_x) < double('inf')"), "places")  # null and NaN are near nothing
    src, dst = places.withColumn(frame, F.col(frame) + 1), places

    def sole(own: DataFrame, other: DataFrame) -> DataFrame:
        """keys, _id of places that hold one point with one point of the other frame in range, _other: that point."""
        small = lambda df: with_cells(df, search_range / 1.5, "_y", "_x", spread=False)
        crowd = small(other).groupBy(*keys, "_cy", "_cx").agg(F.sum("_n").alias("_m")).where("_m > 1").drop("_m")
        few = small(own.where("_n = 1")).join(crowd, [*keys, "_cy", "_cx"], "left_anti").drop("_cy", "_cx")
        there = other.select(*keys, F.col("_y").alias("_y2"), F.col("_x").alias("_x2"), F.col("_n").alias("_m"), F.col("_id").alias("_other"))
        near = with_cells(few, search_range, "_y", "_x", spread=True).join(with_cells(there, search_range, "_y2", "_x2", spread=False), [*keys, "_cy", "_cx"])
        d2 = (F.col("_y") - F.col("_y2")) * (F.col("_y") - F.col("_y2")) + (F.col("_x") - F.col("_x2")) * (F.col("_x") - F.col("_x2"))
        return near.where(d2 < search_range * search_range).groupBy(*keys, "_id").agg(F.sum("_m").alias("_m"), F.min("_other").alias("_other")).where("_m = 1").drop("_m")

    ahead = sole(src, dst).withColumnsRenamed({"_id": "src", "_other": "dst"})
    back = sole(dst, src).withColumnsRenamed({"_id": "dst", "_other": "src"})
    return ahead.join(back, [*keys, "src", "dst"]).select(*by, F.col(frame).alias("frame"), "src", "dst")


def brightest(points: DataFrame, n: int, by: list[str], value: str, *ties: str) -> DataFrame:
    """The n rows of highest value of each group, ties in the given order."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    return points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def brightest_overall(points: DataFrame, n: int, value: str, *ties: str) -> DataFrame:
    return points.orderBy(F.desc(value), *ties).limit(n)


def above_percentile(points: DataFrame, percent: float, by: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds the interpolated percentile of their group, by one aggregate and a join."""
    bound = points.groupBy(*by).agg(F.percentile(value, percent / 100.0).alias("_bound"))
    return points.join(bound, by).where(F.col(value) > F.col("_bound")).drop("_bound")


def within_margin(points: DataFrame, margin: int, rows: int, cols: int, u: str = "u", v: str = "v") -> DataFrame:
    return points.where(F.col(u).between(margin, rows - margin - 1) & F.col(v).between(margin, cols - margin - 1))


def filled_background(points: DataFrame, background: str = "background", by: list[str] | None = None) -> DataFrame:
    """Backgrounds of 0 become the mean of the others, of the group if by is given."""
    mean = points.groupBy(*(by or [])).agg(F.avg(F.nullif(F.col(background), F.lit(0.0))).alias("_mean"))
    joined = points.join(mean, by) if by else points.crossJoin(F.broadcast(mean))  # one row
    return joined.withColumn(background, F.when(F.col(background) == 0, F.col("_mean")).otherwise(F.col(background))).drop("_mean")


def histogram(points: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, count, density over equal bins; the last one includes its upper end. Empty bins have no row."""
    rows = points.where(F.col(value).isNotNull())
    if low is None or high is None:
        ends = rows.agg(F.min(value), F.max(value)).first()
        low, high = (ends[0] if low is None else low), (ends[1] if high is None else high)
    if low is None or not high > low:
        raise ValueError("the histogram has no range")
    width = (high - low) / bins
    inside = rows.where(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    total = inside.agg(F.count("*").alias("_n"))
    return counted.crossJoin(F.broadcast(total)).select("bin", "count", (F.col("count") / (F.col("_n") * width)).alias("density"))


def subpixel_bias(points: DataFrame, bins: int = 10, *columns: str) -> DataFrame:
    """axis, bin, count of the fractional parts of coordinates."""
    stacked = points.select(F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("value")) for c in columns or ("x", "y")))).alias("s")).select("s.*")
    return stacked.where("value IS NOT NULL").groupBy("axis", F.least(F.floor(F.pmod("value", F.lit(1.0)) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def pairs_within(left: DataFrame, right: DataFrame, limit: float, left_id: str, right_id: str, by: list[str] | None = None, y: str = "y", x: str = "x") -> DataFrame:
    """by, a, b, d2: the distances below limit of a distance matrix, never the others.

    Cells of side limit make this an equi-join; no pair beyond a neighbourhood is looked at.
    """
    keys = by or []
    a = with_cells(left.select(*keys, F.col(left_id).alias("a"), F.col(y).alias("ya"), F.col(x).alias("xa")), limit, "ya", "xa", spread=False)
    b = with_cells(right.select(*keys, F.col(right_id).alias("b"), F.col(y).alias("yb"), F.col(x).alias("xb")), limit, "yb", "xb", spread=True)
    d2 = (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")) + (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb"))
    return a.join(b, [*keys, "_cy", "_cx"]).withColumn("d2", d2).where(F.col("d2") < limit * limit).select(*keys, "a", "b", "d2")


def nearest(left: DataFrame, right: DataFrame, limit: float, left_id: str, right_id: str, y: str = "y", x: str = "x", by: list[str] | None = None, others: bool = False) -> DataFrame:
    """by, left_id, right_id, distance of the nearest point of right within limit (exclusive), ties to the smaller id.

    With others, a point of right with the same id doesn't count, as where a table is compared with itself. nearest_k() finds it, so a
    crowd within limit costs no more than its points.
    """
    keys = by or []
    known = [F.col(c).isNotNull() for c in keys]
    left, right = (df.where(reduce(lambda p, q: p & q, known)) if known else df for df in (left, right))
    found = nearest_k(left, right, 1, left_id, right_id, by, y, x, others, limit).withColumnRenamed(f"nearest_{right_id}" if right_id == left_id else right_id, "_b")
    return found.groupBy(*keys, left_id).agg(F.min(F.struct("distance", "_b")).alias("best")).select(*keys, left_id, F.col("best._b").alias(f"nearest_{right_id}"), F.col("best.distance").alias("distance"))


def distance_ranks(left: DataFrame, right: DataFrame, limit: float, left_id: str, right_id: str, by: list[str] | None = None) -> DataFrame:
    """by, left_id, right_id, distance, rank: the points within limit of each point, from 0 at the nearest."""
    near = pairs_within(left, right, limit, left_id, right_id, by)
    w = Window.partitionBy(*(by or []), "a").orderBy("d2", "b")
    return near.select(*(by or []), F.col("a").alias(left_id), F.col("b").alias(right_id), F.sqrt("d2").alias("distance"), (F.row_number().over(w) - 1).alias("rank"))


#: A cell of the tree has sixteen below it; those at the bottom hold so many places at most, or are this many levels deep.
LEAF, DEEPEST = 32, 14


def nearest_k(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, by: list[str] | None = None, y: str = "y", x: str = "x", others: bool = False, limit: float | None = None) -> DataFrame:
    """by, left_id, right_id, distance, rank (from 0): the k nearest points of right for each of left, however far or nearer than limit; ties to the smaller id.

    Places of right form a tree of cells, each with the box round its places and their number. Places of left go down the tree, level
    by level: of the cells below those that are still open, one is dropped if it is farther than some others reach that have k points. What is left of each
    place is a few cells, however far apart the two tables are and however crowded they are. Copies of a place go down as one; of a right place its
    k smallest ids count. With others, a point of right with the same id doesn't count. Points without a position have no
    neighbours and are none; a group (by) that right doesn't have gives no rows.
    """
    keys, want = by or [], k + bool(others)
    finite = lambda df: df.where((F.abs(y) < float("inf")) & (F.abs(x) < float("inf")))
    video = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    placed = lambda df, name: finite(df).select(*keys, video.alias("_v"), F.col(name).alias("_id"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    own, there = stored(placed(left, left_id), "left"), placed(right, right_id)
    spot = [*keys, "_v", "_y", "_x"]
    first = there.withColumn("_n", F.row_number().over(Window.partitionBy(*spot).orderBy("_id"))).where(F.col("_n") <= want)
    held = stored(first.groupBy(*spot).agg(F.array_sort(F.collect_list("_id")).alias("_ids")), "places")  # `want` ids a place at most
    low = held.agg(F.min("_y"), F.max("_y"), F.min("_x"), F.max("_x")).first()
    extent = max(low[1] - low[0], low[3] - low[2]) if low[0] is not None else 0.0
    side = (extent or 1.0) * (1 + 1e-9)

    def cells(level: int) -> DataFrame:
        """by, _cy, _cx, what they are part of, their boxes, and how many points they have."""
        size = side / 4.0**level
        at = held.withColumns({"_cy": F.floor((F.col("_y") - F.lit(low[0] or 0.0)) / size), "_cx": F.floor((F.col("_x") - F.lit(low[2] or 0.0)) / size)})
        return at.groupBy(*keys, "_v", "_cy", "_cx").agg(F.min("_y").alias("_y0"), F.max("_y").alias("_y1"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.sum(F.size("_ids")).alias("_n"), F.count("*").alias("_places"))

    open_ = stored(own.select(*spot).distinct().withColumns({"_cy": F.lit(0).cast("long"), "_cx": F.lit(0).cast("long")}), "open")
    level = 0
    while level < DEEPEST and (cells(level).agg(F.max("_places")).first()[0] or 0) > LEAF:
        level += 1
        below = cells(level).withColumns({"_py": F.floor(F.col("_cy") / 4), "_px": F.floor(F.col("_cx") / 4)})
        up = open_.withColumnsRenamed({"_cy": "_py", "_cx": "_px"})
        same = [up["_v"] == below["_v"], up["_py"] == below["_py"], up["_px"] == below["_px"], *(up[c].eqNullSafe(below[c]) for c in keys)]
        both = up.join(below, same).select(*(up[c] for c in spot), below["_cy"], below["_cx"], "_y0", "_y1", "_x0", "_x1", "_n")
        near = lambda c, a, b: F.greatest(F.col(a) - F.col(c), F.col(c) - F.col(b), F.lit(0.0))
        far = lambda c, a, b: F.greatest(F.abs(F.col(c) - F.col(a)), F.abs(F.col(c) - F.col(b)))
        square = lambda f: f("_y", "_y0", "_y1") * f("_y", "_y0", "_y1") + f("_x", "_x0", "_x1") * f("_x", "_x0", "_x1")
        of = Window.partitionBy(*spot)
        ranged = both.withColumns({"_near": square(near), "_far": square(far)})
        ranged = ranged.withColumn("_upto", F.sum("_n").over(of.orderBy("_far").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        ranged = ranged.withColumn("_limit", F.min(F.when(F.col("_upto") >= want, F.col("_far"))).over(of))
        in_reach = ranged if limit is None else ranged.where(F.col("_near") < limit * limit)
        kept = stored(in_reach.where(F.col("_near") <= F.coalesce("_limit", F.lit(float("inf")))).select(*spot, "_cy", "_cx"), "open")
        forget(open_)
        open_ = kept
    size = side / 4.0**level
    leaves = held.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)), F.col("_v").alias("_w"), F.floor((F.col("_y") - F.lit(low[0] or 0.0)) / size).alias("_ly"), F.floor((F.col("_x") - F.lit(low[2] or 0.0)) / size).alias("_lx"), F.col("_y").alias("_yb"), F.col("_x").alias("_xb"), "_ids")
    on = [F.col("_v") == F.col("_w"), F.col("_cy") == F.col("_ly"), F.col("_cx") == F.col("_lx"), *(F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(keys))]
    d2 = (F.col("_y") - F.col("_yb")) * (F.col("_y") - F.col("_yb")) + (F.col("_x") - F.col("_xb")) * (F.col("_x") - F.col("_xb"))
    pairs = open_.join(leaves, on).select(*spot, d2.alias("_d2"), "_ids")
    pairs = (pairs if limit is None else pairs.where(F.col("_d2") < limit * limit)).select(*spot, "_d2", F.explode("_ids").alias("_b"))
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*spot).orderBy("_d2", "_b"))).where(F.col("_n") <= want)
    lists = stored(best.groupBy(*spot).agg(F.array_sort(F.collect_list(F.struct("_d2", "_b"))).alias("_best")), "nearest")
    found = lists.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)), F.col("_v").alias("_w"), F.col("_y").alias("_yb"), F.col("_x").alias("_xb"), "_best")
    same = [F.col("_v") == F.col("_w"), F.col("_y") == F.col("_yb"), F.col("_x") == F.col("_xb"), *(F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(keys))]
    chosen = F.slice(F.filter("_best", lambda p: p["_b"] != F.col("_id")) if others else F.col("_best"), 1, k)
    rows = own.join(found, same).select(*keys, "_id", F.posexplode(chosen).alias("rank", "_p"))
    return rows.select(*keys, F.col("_id").alias(left_id), F.col("_p._b").alias(right_id if right_id != left_id else f"nearest_{right_id}"), F.sqrt("_p._d2").alias("distance"), "rank")


def matched(left: DataFrame, right: DataFrame, limit: float = 0.01, by: tuple[str, ...] = ("frame",), order: str = "seq") -> DataFrame:
    """by, order of left, of right, distance: detections of two engines that are each other's nearest within limit."""
    keys = list(by)
    there = nearest(left, right, limit, order, order, by=keys).withColumnsRenamed({order: "left_id", f"nearest_{order}": "right_id"})
    back = nearest(right, left, limit, order, order, by=keys).select(*keys, F.col(order).alias("right_id"), F.col(f"nearest_{order}").alias("left_id"))
    return there.join(back, [*keys, "left_id", "right_id"])


def relabelled(tracks: DataFrame, particle: str, order: str, by: list[str] | None = None) -> DataFrame:
    """particle numbered by first appearance in order; one row for each track is ranked, not each detection.

    Without by, the tracks are ranked range by range, and the ranges' sizes are added up on the driver.
    """
    keys = [*(by or []), particle]
    first = tracks.groupBy(*keys).agg(F.min(order).alias("_first"))
    if not by:
        ranged = stored(first.repartitionByRange("_first").withColumn("_range", F.spark_partition_id()), "ranged")
        w = Window.partitionBy("_range").orderBy("_first")
        sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
        before = [(k, sum(n for _, n in sizes[:i])) for i, (k, _) in enumerate(sizes)]
        offset = tracks.sparkSession.createDataFrame(before, "_range int, _before long")  # a row for each range
        ranked = ranged.withColumn("_n", F.row_number().over(w) - 1).join(F.broadcast(offset), "_range").select(particle, (F.col("_n") + F.col("_before")).alias("_new"))
        return tracks.join(ranked, particle).withColumn(particle, F.col("_new")).drop("_new")
    w = Window.partitionBy(*by).orderBy("_first")
    return tracks.join(first.withColumn("_new", (F.row_number().over(w) - 1).cast("bigint")).drop("_first"), keys).withColumn(particle, F.col("_new")).drop("_new")


def by_particle(tracks: DataFrame, by: list[str] | None = None, frame: str = "frame") -> DataFrame:
    """Tracks one after the other, each by frame: sorted ranges, not one sorted whole."""
    keys = [*(by or []), "particle", frame]
    return tracks.repartitionByRange(*keys).sortWithinPartitions(*keys)


def unique_ids(tracks: DataFrame, run_id: str, particle: str = "particle") -> DataFrame:
    return tracks.withColumn(particle, F.concat_ws("_", F.col(particle).cast("string"), F.lit(run_id)))
