import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spotflow.operators import detections as det
from spotflow.operators import frames as fr
from spotflow.operators import motion
from spotflow.plans import web
from spotflow.plans import catalogue
from spotflow.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(clean(v.item() if hasattr(v, "item") else v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_msd_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 3.0, 0.0), (1, 4, 3.0, 4.0)], "particle int, frame int, x double, y double")
    assert [(r.lag, r.msd, r.n) for r in motion.msd(df, 6).orderBy("lag").collect()] == [(1, 2.5, 2), (2, 12.5, 2), (3, 20.0, 1), (4, 25.0, 1)]


def test_imsd_of_all_particles(spark):
    want = {(float(r.lag), r.particle, r.msd) for r in QUERIES["msd"](spark, SF).collect()}
    assert len({p for _, p, _ in want}) > 3
    assert {tuple(r) for r in QUERIES["imsd_long"](spark, SF).select("time", "particle", "msd").collect()} == want
    wide = QUERIES["imsd_wide"](spark, SF).collect()
    assert {(r.time, r.first + k, r[f"p{k}"]) for r in wide for k in range(10) if r[f"p{k}"] is not None} == want


def test_imsd_by_named_particles(spark):
    df = spark.createDataFrame([(p, t, float(p * t), 0.0) for p in (1, 2) for t in range(3)], "particle int, frame int, x double, y double")
    wide = motion.imsd(df, 1.0, 1.0, 5, [1, 2])
    assert sorted(map(tuple, wide.collect())) == [(1.0, 1.0, 4.0), (2.0, 4.0, 16.0)]
    assert sorted(map(tuple, motion.imsd_long(wide).collect())) == [(1.0, "1", 1.0), (1.0, "2", 4.0), (2.0, "1", 4.0), (2.0, "2", 16.0)]


def test_lags_end_with_their_track(spark):
    """A short track beside a long one makes no rows that find nothing."""
    df = spark.createDataFrame([(1, t, 1.0, 1.0) for t in range(50)] + [(2, t, 0.0, 0.0) for t in range(3)], "particle int, frame int, x double, y double")
    got = {(r.particle, r.lag): r.n for r in motion.msd(df, 40).collect()}
    assert got == {(1, k): 50 - k for k in range(1, 41)} | {(2, 1): 2, (2, 2): 1}


def test_distances_of_two_engines(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 5.0, 5.0), (1, 3, 0.0, 0.0)], "frame int, seq int, y double, x double")
    b = spark.createDataFrame([(0, 8, 0.004, 0.0), (0, 9, 0.006, 0.0), (1, 7, 9.0, 9.0)], "frame int, seq int, y double, x double")
    assert [tuple(r)[:3] for r in det.matched(a, b).collect()] == [(0, 1, 8)]
    ranks = det.distance_ranks(a, b, 0.01, "seq", "seq", ["frame"]).collect()
    assert sorted((r[0], r[1], r[2], r.rank) for r in ranks) == [(0, 1, 8, 0), (0, 1, 9, 1)]
    assert det.nearest(a, a, 9.0, "seq", "seq", by=["frame"], others=True).count() == 2


def test_order_by_particle_and_labels_over_ranges(spark):
    rows = [(p, t) for t in range(40) for p in range(30, 0, -1)]
    df = spark.createDataFrame(rows, "particle int, frame int").repartition(5)
    assert [tuple(r) for r in det.by_particle(df).collect()] == sorted(rows)
    named = spark.createDataFrame([(f"p{i}", (i * 37) % 500) for i in range(500)], "particle string, seq int").repartition(4)
    assert all(r.particle == r.seq for r in det.relabelled(named, "particle", "seq").collect())


def test_set_zero_by_hand(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([4.0, 2.0, 6.0])], "particle int, frame int, x double")
    assert [r.x for r in motion.set_zero(df, "x").orderBy("frame").collect()] == [2.0, 0.0, 4.0]


def test_nearest_and_margin(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "a int, y double, x double")
    b = spark.createDataFrame([(7, 0.0, 3.0), (8, -2.0, 0.0), (9, 20.0, 20.0)], "b int, y double, x double")
    assert [tuple(r) for r in det.nearest(a, b, 5.0, "a", "b").collect()] == [(1, 8, 2.0)]
    p = spark.createDataFrame([(0, 3), (2, 2), (5, 5)], "u int, v int")
    assert [tuple(r) for r in det.within_margin(p, 1, 6, 6).collect()] == [(2, 2)]


def test_masks_and_grey(spark):
    import numpy as np

    video = np.random.default_rng(0).gamma(4.0, 5.0, (2, 20, 20)).astype(np.float32)
    video[:, 8:12, 8:12] += 200
    frames = fr.frames_from_array(spark, video)
    assert all(r.px[9 * 20 + 9] == 1 for r in fr.foam_mask(frames, 9, 1).collect())
    assert set(fr.background_pixels(frames).collect()[0].px) <= {0.0, 1.0}
    grey = fr.to_grey(frames.selectExpr("video_id", "frame", "px AS r", "px AS g"), ["r", "g"]).first().px
    assert max(grey) == pytest.approx(255)
    flat = fr.illumination_corrected(frames, 3.0).first()
    assert len(flat.px) == 400
    assert max(fr.inverted(frames).first().px) == pytest.approx(float(video[0].max() - video[0].min()), rel=1e-6)
    assert set(fr.stages(frames, fr.TrackingParams(3, separation=3))) == {"processed", "centres", "candidates"}


def test_reach(spark):
    page = lambda k, url, *to: (k, url, "".join(f'<a href="{t}">x</a>' for t in to))
    pages = spark.createDataFrame([page(1, "http://h/a", "/b", "/x.png"), page(2, "http://h/b", "/c"), page(3, "http://h/c", "/a"), page(4, "http://h/d")], "page_id int, url string, html string")
    got = web.reached(pages, spark.createDataFrame([("http://h/a",)], "url string"), 5)
    assert sorted((r.url[-1], r.round) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_sole_links_are_found_without_the_edges(spark, tmp_path):
    """A crowd of 1,500 points in each of two frames, whose 2,250,000 edges no shuffle has to carry."""
    at = lambda t, n, value, k: f"SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {6 * t}) AS ts, CAST(id AS BIGINT) AS id, CAST({value} AS DOUBLE) AS value, '{{\"k\": {k}}}' AS props FROM range({n})"
    parts = [at(t, 1500, "20 + id % 3", 50) for t in (0, 1)] + [at(0, 1, 300, 5), at(1, 1, 310, 5), at(1, 1, "'NaN'", 5), at(0, 2, "500 + id", 5), at(1, 1, 505, 5), at(2, 1, 519.9, 5)]
    events = spark.sql(" UNION ALL ".join(parts)).selectExpr("row_number() OVER (ORDER BY ts, value, id) AS event_id", "ts", "id AS user_id", "value", "props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    before = shuffled(spark)
    got = rows(QUERIES["trivial_links"](spark, str(tmp_path)).toPandas())
    assert shuffled(spark) - before < 50_000
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == rows(c.sql(ORACLES["trivial_links"]).df()) and len(got) == 2


def test_sole_links_of_random_points(spark):
    import random

    rng = random.Random(3)
    made = [("ab"[i % 2], rng.randint(0, 3), i, rng.choice([round(rng.random() * 40), rng.random() * 90]), rng.random() * 30) for i in range(400)]
    made += [("a", 1, 400, None, 1.0), ("a", 2, 401, float("nan"), 1.0), ("a", 1, 402, -0.0, 80.0), ("a", 2, 403, 0.0, 80.0), ("a", 2, 404, 0.0, 95.0)]
    df = spark.createDataFrame([(v, t, i, None if y is None else float(y), x) for v, t, i, y, x in made], "video_id string, frame int, seq long, y double, x double")
    want = det.trivial_links(det.link_edges(df, 5.0, ["video_id"], "seq"), ["video_id"]).select("video_id", "frame", "src", "dst").collect()
    assert sorted(det.sole_links(df, 5.0, ["video_id"], "seq").collect()) == sorted(want) and len(want) > 10


def test_edges_of_copies_travel_as_places(spark, tmp_path):
    """40 places in each of two frames, 100 times each: what is shuffled are places, not their pairs or copies."""
    made = spark.sql("SELECT CAST(id % 2 AS BIGINT) AS frame, id AS seq, CAST((id DIV 2) % 40 AS DOUBLE) AS y, 0.0D AS x FROM range(8000) UNION ALL SELECT 1L, 9000L, double('NaN'), 0.0D UNION ALL SELECT 0L, 9001L, null, 0.0D")
    made.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    before = shuffled(spark)
    edges = det.link_edges(points, 2.0, [], "seq")
    got = edges.selectExpr("count(*) AS n", "sum(d2) AS s").first()
    assert shuffled(spark) - before < 4000  # 8,000 points in 40 places a frame
    assert tuple(got) == ((40 + 2 * 39) * 10_000, 2 * 39 * 10_000.0)
    assert edges.where("src < 200 AND dst < 200").distinct().count() == edges.where("src < 200 AND dst < 200").count() > 0
    before = shuffled(spark)
    pairs = det.place_edges(points, 2.0, [], "seq").collect()
    assert shuffled(spark) - before < 4000 and len(pairs) == 40 + 2 * 39 and {(r.n_src, r.n_dst) for r in pairs} == {(100, 100)}


@pytest.mark.parametrize("name", ["link_edges_grid", "link_edges_theta"])
def test_every_edge_of_copies_is_a_row(spark, tmp_path, name):
    """Three detections at one place, two in range of them in the next frame: six edges, each with its ends."""
    at = [(0, "00:00", 10.0)] * 3 + [(0, "06:00", 12.0)] * 2 + [(0, "06:00", 400.0)]
    made = [(i, f"2024-01-01 {t}:00", u, v, '{"k": 5}') for i, (u, t, v) in enumerate(at)]
    spark.createDataFrame(made, "event_id long, ts string, user_id long, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.frame, r.src, r.dst, r.d2) for r in got) == [(1, a, b, 4.0) for a in (0, 1, 2) for b in (3, 4)]


def test_places_stand_for_their_edges(spark):
    """Pairs of places and their members together are the edges; degrees count them."""
    import random
    from collections import Counter

    rng = random.Random(4)
    made = [("ab"[i % 2] if i % 7 else None, rng.randint(0, 3), i, float(rng.randint(0, 12)), float(rng.randint(0, 3))) for i in range(300)]
    made += [("a", 1, 400, None, 1.0), ("a", 2, 401, float("nan"), 1.0), ("a", 2, 402, float("inf"), 1.0)]
    df = spark.createDataFrame(made, "video_id string, frame int, seq long, y double, x double")
    edges = {(r.video_id, r.frame, r.src, r.dst) for r in det.link_edges(df.where("video_id IS NOT NULL"), 3.0, ["video_id"], "seq").collect()}
    members = {}
    for r in det.place_members(df, ["video_id"], "seq").collect():
        members.setdefault(r.place, []).append(r.seq)
    assert sorted(members.pop(None)) == [400, 401, 402] and sum(map(len, members.values())) == 300
    pairs = det.place_edges(df, 3.0, ["video_id"], "seq").collect()
    assert all((len(members[r.src]), len(members[r.dst])) == (r.n_src, r.n_dst) for r in pairs)
    assert {(r.video_id, r.frame, a, b) for r in pairs for a in members[r.src] for b in members[r.dst]} == edges
    degrees = {r.seq: (r.n_before, r.n_after) for r in det.link_degrees(df, 3.0, ["video_id"], "seq").collect()}
    ahead, back = Counter(e[2] for e in edges), Counter(e[3] for e in edges)
    assert degrees == {r[2]: (back[r[2]], ahead[r[2]]) for r in made}


def test_counts_in_range_by_brute_force():
    """Whole numbers on the border, copies, one strip, far from zero, none; and however few are looked at together."""
    import numpy as np
    from spotflow.functions.spacetime import near_counts

    rng = np.random.default_rng(3)
    kinds = [lambda n: rng.integers(0, 60, (n, 2)) * 1.0, lambda n: rng.random((n, 2)) * 80, lambda n: np.stack([rng.exponential(50, n).round(2), rng.integers(0, 100, n)], 1)]
    kinds += [lambda n: rng.random((n, 2)) * 9, lambda n: rng.random((n, 2)) * 50 + 1e12, lambda n: rng.integers(-3, 3, (n, 2)) * 5.0]
    for trial in range(60):
        (n, m), kind = rng.integers(0, 150, 2), kinds[trial % len(kinds)]
        src, dst, weight = kind(n), kind(m), rng.integers(1, 5, n)
        d2 = (src[None, :, 0] - dst[:, None, 0]) ** 2 + (src[None, :, 1] - dst[:, None, 1]) ** 2
        for at_once in (1, 70, 1 << 17):
            assert near_counts(src, weight, dst, 15.0, at_once).tolist() == ((d2 < 225) * weight[None, :]).sum(axis=1).tolist()


def test_degrees_of_a_crowd_make_no_pairs(spark):
    """Two frames of 150,000 places in range of one another: 2.25e10 edges, counted and not made."""
    points = spark.range(300_000).selectExpr("id AS seq", "CAST(id % 2 AS INT) AS frame", "id DIV 2 * 1e-5 AS y", "(id DIV 2) % 7 * 1.0 AS x")
    got = det.link_degrees(points, 10.0, [], "seq").groupBy("frame", "n_before", "n_after").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 150_000, 150_000), (1, 150_000, 0, 150_000)]


def test_place_pairs_need_no_join(spark):
    """A place goes to its block and those beside it, and the pairs of a block are made in passing."""
    points = spark.range(900).selectExpr("id AS seq", "CAST(id % 3 AS INT) AS frame", "(id DIV 3) % 20 * 1.0 AS y", "id DIV 60 * 1.0 AS x")
    pairs = det.place_edges(points, 2.0, [], "seq")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert pairs.count() == pairs.distinct().count() == 2 * (20 * 15 + 2 * 19 * 15 + 2 * 20 * 14 + 4 * 19 * 14)


def test_columns_of_other_names(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 7), (1, 2, 1.0, 0.0, 8), (1, 3, 1.0, 0.0, 9)], "t int, k long, v double, u double, n int")
    assert [tuple(r) for r in det.place_edges(df, 2.0, [], "k", "t", "v", "u").collect()] == [(1, 1, 2, 1, 2, 1.0)]
    assert {(r.k, r.place, r.n) for r in det.place_members(df, [], "k", "t", "v", "u").collect()} == {(1, 1, 7), (2, 2, 8), (3, 2, 9)}
    assert {(r.k, r.n_before, r.n_after) for r in det.link_degrees(df, 2.0, [], "k", "t", "v", "u").collect()} == {(1, 0, 2), (2, 1, 0), (3, 1, 0)}


def brute_msd(rows, max_lag):
    out = {}
    for p, f, x, y in rows:
        for p2, f2, x2, y2 in rows:
            if p == p2 and 1 <= f2 - f <= max_lag:
                s, n = out.get((p, f2 - f), (0.0, 0))
                out[p, f2 - f] = (s + (x2 - x) ** 2 + (y2 - y) ** 2, n + 1)
    return {k: (s / n, n) for k, (s, n) in out.items()}


@pytest.mark.parametrize(("max_lag", "block"), [(3, 4), (7, 7), (40, 10), (150, 4096), (150, 20)])
def test_msd_with_gaps_and_repeated_frames(spark, max_lag, block):
    """Blocks of any size, lags by comparison or by transforms, whole numbers or not."""
    import random

    rng = random.Random(max_lag)
    made = [(p, f, round(rng.random() * 30, 2), round(-5 + rng.random() * 9, 2)) for p in (1, 2, None) for f in range(-20, 280) if rng.random() < (0.9 if p == 1 else 0.2)]
    made += [(1, f, 1.0, 2.0) for f in (3, 3, 4)] + [(7, 0, 1.0, 1.0), (8, 0, 1.0, 1.0), (8, 10**9, 2.0, 2.0)]
    df = spark.createDataFrame([*made, (1, 5, None, 1.0), (1, 5, float("nan"), 1.0), (1, None, 1.0, 1.0)], "particle int, frame int, x double, y double").repartition(3)
    want = brute_msd(made, max_lag)
    for scale in (None, 100):
        got = {(r.particle, r.lag): (r.msd, r.n) for r in motion.msd(df, max_lag, scale=scale, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], rel=1e-9, abs=1e-9) for k in want)


def test_transforms_equal_comparisons():
    import numpy as np

    from spotflow.functions.displacement import lag_sums

    rng = np.random.default_rng(3)
    frame = np.sort(rng.choice(5000, 3000, replace=False))
    x, y = np.cumsum(rng.integers(-9, 10, 3000)), np.cumsum(rng.integers(-9, 10, 3000))
    a, b = (lag_sums(np.zeros(3000, np.int64), frame, x, y, frame < 4000, 700, many) for many in (128, 10**9))
    assert all((u == v).all() for u, v in zip(a, b)) and len(a[1]) == 700


def test_repeated_positions(spark):
    import numpy as np

    from spotflow.operators import photometry

    frames = fr.frames_from_array(spark, np.random.default_rng(1).random((2, 12, 12)).astype(np.float32))
    at = [(1, 3.0, 4.0)] * 50 + [(2, 5.5, 5.5), (3, 6.0, 6.0)]
    df = spark.createDataFrame(at, "particle long, y double, x double")
    whole = photometry.constant_positions(frames, df, 2, 8, 1)
    parts = photometry.constant_positions(frames, df, 2, 8, 1, most=1)
    assert whole.count() == 104 and sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


@pytest.mark.parametrize(("k", "others"), [(1, False), (4, True), (60, False)])
def test_nearest_without_a_limit(spark, monkeypatch, k, others):
    """Clusters, copies, far and lonely points, several videos: the k nearest by brute force."""
    import random

    monkeypatch.setattr(det, "LEAF", 3)
    rng = random.Random(k)
    def points(n, base):
        out = []
        for i in range(n):
            v = rng.choice(["a", "b", None])
            cy, cx = rng.choice([(0, 0), (1e6, 1e6), (5, 3)])
            out.append((v, base + i, round(cy + rng.random() * 2, 1), round(cx + rng.gauss(0, 1), 1)))
        return out
    left, right = points(120, 0), points(90, 60)
    left += [("a", 500, -1e9, 0.0), ("c", 501, 0.0, 0.0), ("a", 502, None, 0.0), ("b", 503, float("nan"), 1.0)] + left[:5]
    right += [("a", 600 + i, 7.0, 7.0) for i in range(9)] + [("a", 700, float("inf"), 0.0), ("d", 701, 0.0, 0.0)]
    kind = "video_id string, seq long, y double, x double"
    got = det.nearest_k(spark.createDataFrame(left, kind).repartition(3), spark.createDataFrame(right, kind), k, "seq", "seq", ["video_id"], others=others)
    found = sorted(((r.video_id, r.seq, r.rank, r.nearest_seq, round(r.distance, 9)) for r in got.collect()), key=str)
    ok = lambda p: p[2] is not None and abs(p[2]) < float("inf") and abs(p[3]) < float("inf")
    want = []
    for v, i, y, x in filter(ok, left):
        near = sorted(((y - q[2]) ** 2 + (x - q[3]) ** 2, q[1]) for q in right if q[0] == v and ok(q) and not (others and q[1] == i))
        want += [(v, i, n, b, round(d**0.5, 9)) for n, (d, b) in enumerate(near[:k])]
    assert found == sorted(want, key=str)
    empty = spark.createDataFrame([], kind)
    full = spark.createDataFrame(right, kind)
    assert det.nearest_k(full, empty, k, "seq", "seq").count() == det.nearest_k(empty, full, k, "seq", "seq").count() == 0


def test_nearest_in_a_crowd_makes_no_pairs(spark):
    """2,000 points within one limit of each other: rows of stages grow with points, not with their four million pairs."""
    points = spark.sql("SELECT id AS seq, CAST(id % 50 AS DOUBLE) / 10 AS y, CAST(id DIV 50 AS DOUBLE) / 10 AS x FROM range(2000) UNION ALL SELECT 5000, 90.0D, 0.0D UNION ALL SELECT 5001, 90.0D, 10.0D")
    pairs = det.nearest(points, points, 10.0, "seq", "seq", others=True)
    assert max(rows_joined(pairs)) < 400_000
    near = {r.seq: (r.nearest_seq, round(r.distance, 9)) for r in pairs.collect()}
    assert near[0] == (1, 0.1) and near[1999] == (1949, 0.1) and len(near) == 2000


def rows_joined(df):
    """Rows out of each join of a query that has run."""
    df.collect()
    seen, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage") or "QueryStage" in node.nodeName():
            stack.append(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_edges_travel_as_few_copies_of_their_detections(spark, tmp_path):
    """20,000 places in ten frames, each looked for in blocks: no copy for every cell round it. The edges are those of all pairs."""
    made = spark.sql("SELECT CAST(id % 10 AS BIGINT) AS frame, id AS seq, CAST(pmod(xxhash64(id), 200000) AS DOUBLE) / 100 - 500 AS y, CAST(pmod(xxhash64(id, 1), 200000) AS DOUBLE) / 100 AS x FROM range(20000)")
    made.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    before = shuffled(spark)
    got = sorted((r.frame, r.src, r.dst, r.d2) for r in det.link_edges(points, 15.0, [], "seq").collect())
    assert shuffled(spark) - before < 90_000  # with nine copies it is over 200,000
    c = duckdb.connect()
    want = c.sql(f"WITH p AS (SELECT * FROM '{tmp_path}/points/*.parquet') SELECT b.frame, a.seq, b.seq, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM p a JOIN p b ON b.frame = a.frame + 1 WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) < 225").fetchall()
    assert got == sorted(want) and len(got) > 5000


def test_fast_rounding_is_rounding(spark):
    values = [0.1234565, 2.5e-7, 224.99999949999, 1.0000005, 3.3333333, 7.7777775, 0.0, 1e7 + 0.1234565]
    df = spark.createDataFrame([(v,) for v in values], "d2 double")
    assert df.select(catalogue.r6_fast("d2")).collect() == df.select(*catalogue.r6("d2")).collect()


def test_edges_leave_out_what_has_no_frame(spark):
    made = [("a", 0, 1, 1.0, 1.0), ("a", 1, 2, 2.0, 1.0), ("a", None, 3, 1.0, 1.0), ("a", None, 4, 1.0, 200.0), (None, 1, 5, 1.0, 1.0), ("a", -1, 6, 1.0, -1.0)]
    df = spark.createDataFrame(made, "video_id string, frame int, seq long, y double, x double")
    edges = det.link_edges(df, 3.0, ["video_id"], "seq")
    assert sorted(map(tuple, edges.collect())) == [("a", 0, 6, 1, 4.0), ("a", 1, 1, 2, 1.0)]
    assert det.link_edges(df.where("seq > 9"), 3.0, ["video_id"], "seq").collect() == []
