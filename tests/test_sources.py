import numpy as np
import pytest

from spotflow.plans.pipeline import LabParams, TraceParams, batch, batch_array, batch_file, extract_pairs, extract_traces, parse_ets, run_experiments, sweep, tracker
from spotflow.operators.frames import frames_from_array, to_bytes
from spotflow.sources.ets import channels, chunk, parse_header, read_ets, write_ets
from spotflow.__main__ import main, parsed
from spotflow.plans.pipeline import detections_of
from spotflow.sources.tables import gathered_runs, merged_results, read_detections, read_frames, write_results, write_run, write_traces
from spotflow.sources.tiff import content_hashes, directories, listed_page, manifest, page, pages, read_tiff, unpack_bits, unpack_lzw, write_tiff
from test_imaging import spot_image


def video(n=6, seed=1, kind=np.uint16):
    rng = np.random.default_rng(seed)
    start = rng.random((4, 2)) * [20, 30] + 8
    return np.stack([np.clip(spot_image([(y + 0.4 * t, x + 0.3 * t, 900) for y, x in start], seed=t), 0, 60000) for t in range(n)]).astype(kind)


def test_tiff_round_trip(spark, tmp_path):
    for kind in (np.uint8, np.uint16):
        a = (np.random.default_rng(0).random((3, 5, 7)) * 200).astype(kind)
        data = write_tiff(a)
        assert (np.stack([page(data, t) for t in directories(data)]) == a).all()
    (tmp_path / "b.tif").write_bytes(write_tiff(a))
    (tmp_path / "a.tif").write_bytes(write_tiff(a + 1))
    rows = read_tiff(spark, str(tmp_path)).orderBy("video_id", "frame").collect()
    assert [r.frame for r in rows] == [0, 1, 2] * 2 and rows[3].px == a[0].ravel().tolist()
    assert [(r.path[-5:], r.replicate) for r in manifest(spark, str(tmp_path), "e").orderBy("path").collect()] == [("a.tif", 0), ("b.tif", 1)]
    assert content_hashes(spark, str(tmp_path)).select("sha1").distinct().count() == 2
    assert unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    with pytest.raises(ValueError):
        list(directories(b"nothing"))
    with pytest.raises(ValueError):
        read_frames(spark, "a.png")


def counting(data):
    """A reader that notes what it is asked for."""
    asked = []

    def read(at, n):
        asked.append((at, n))
        return data[at : at + n]

    return read, asked


def test_a_range_reads_its_own_bytes_only():
    a = (np.random.default_rng(0).random((6, 16, 16)) * 200).astype(np.uint16)
    data = write_tiff(a)
    read, asked = counting(data)
    found = list(pages(read))
    assert sum(n for _, n in asked) < 6 * 150 and len(found) == 6
    asked.clear()
    assert (listed_page(read, found[4]) == a[4]).all() and [n for _, n in asked] == [512]
    images = {c: {f: np.full((16, 16), 10 * c + f) for f in range(3)} for c in (0, 1)}
    read, asked = counting(write_ets(images))
    header = parse_header(read)
    assert sum(n for _, n in asked) < 500
    asked.clear()
    assert (chunk(read, header, header["chunks"][1, 2]) == 12).all() and [n for _, n in asked] == [512]


def test_ranges_of_frames_are_tasks(spark, tmp_path):
    a = (np.random.default_rng(0).random((10, 5, 7)) * 200).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(write_tiff(a))
    frames = read_tiff(spark, str(tmp_path), frames=2)
    assert frames.rdd.getNumPartitions() == 5
    assert [(r.frame, r.px) for r in frames.orderBy("frame").collect()] == [(k, a[k].ravel().tolist()) for k in range(10)]


def test_lzw_and_differences():
    def packed(data):
        """An encoder by the book: a new code for each longest known string and the byte behind it."""
        out, bits, codes, width, held = 0, 0, {bytes([k]): k for k in range(256)}, 9, b""
        emit = [(256, 9)]
        for k in range(len(data)):
            c = data[k : k + 1]
            if held + c in codes:
                held += c
                continue
            emit.append((codes[held], width))
            codes[held + c] = len(codes) + 2
            held = c
            if len(codes) + 2 >= (1 << width) and width < 12:
                width += 1
            if len(codes) + 2 >= 4094:
                emit.append((codes[held], width))
                emit.append((256, width))
                codes, width, held = {bytes([k]): k for k in range(256)}, 9, b""
        emit += ([(codes[held], width)] if held else []) + [(257, width)]
        for code, n in emit:
            out, bits = out << n | code, bits + n
        return (out << (-bits % 8)).to_bytes((bits + 7) // 8, "big")

    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"aaaaaaa" * 50, bytes(rng.integers(0, 4, 700).astype(np.uint8)), bytes(rng.integers(0, 256, 20_000).astype(np.uint8))):
        assert unpack_lzw(packed(data)) == data
    image = rng.integers(0, 60_000, (6, 9)).astype("<u2")
    steps = np.diff(image.astype(np.int64), axis=1, prepend=0).astype(np.uint16).astype("<u2")
    data = packed(steps.tobytes())
    tags = {256: [9], 257: [6], 258: [16], 259: [5], 273: [0], 279: [len(data)], 317: [2], -1: [False]}
    assert (page(data, tags) == image).all()


def test_ets_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {c: {f: rng.integers(0, 999, (4, 6)) for f in frames} for c, frames in {0: (0, 1, 3), 2: (1,)}.items()}
    (tmp_path / "x.ets").write_bytes(write_ets(images))
    rows = {(r.channel, r.frame): r for r in parse_ets(spark, str(tmp_path / "x.ets")).collect()}
    assert set(rows) == {(0, 0), (0, 1), (0, 3), (2, 1)}
    assert (np.array(rows[0, 3].px).reshape(4, 6) == images[0][3]).all() and (rows[2, 1].nrows, rows[2, 1].ncols) == (4, 6)
    assert [r.frame for r in read_ets(spark, str(tmp_path), 0, compact_missing=True).orderBy("frame").collect()] == [0, 1, 2]
    assert {(r.channel, r.frames) for r in channels(spark, str(tmp_path)).collect()} == {(0, 3), (2, 1)}


def test_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text("x,y,frame\n1.5,2,0\n3,4.25,1\n")
    assert [tuple(r) for r in read_detections(spark, str(tmp_path / "d.csv")).collect()] == [(1.5, 2.0, 0), (3.0, 4.25, 1)]
    for k, name in enumerate("ab"):
        write_results(spark.createDataFrame([(k, "t", 0)], f"{name} int, experiment_type string, replicate int"), str(tmp_path / name))
    merged = merged_results(spark, [str(tmp_path / n) for n in "ab"])
    assert set(merged.columns) == {"a", "b", "experiment_type", "replicate"} and merged.count() == 2


def test_runs_by_name(spark, tmp_path):
    save = str(tmp_path / "out")
    paths = [p for k in (0, 1) for p in write_run({"tracked": spark.createDataFrame([(k, 1.5)], "particle int, x double"), "msd": spark.createDataFrame([(k, 2.0)], "particle int, msd double")}, save, "exp", k)]
    assert paths[0] == f"{save}__exp__0__full_tracked_.csv" and paths[3] == f"{save}__exp__1__MSD_.csv"
    found = gathered_runs(spark, paths, str(tmp_path / "all"))
    assert found["tracked"].columns == ["particle", "x"] and found["msd"].columns == ["particle", "msd"] and found["msd"].count() == 2
    assert spark.read.csv(str(tmp_path / "all" / "all_tracked.csv"), header=True).count() == 2
    one = spark.createDataFrame([(1,)], "a int")
    assert [p.rsplit("/", 1)[1] for p in write_traces({"tracks": one, "traces": one, "static": one}, str(tmp_path), 3)] == ["3_dynamic_tracks.csv", "3_dynamic_signal_in_static_positions.csv", "3_static_df.csv"]


def test_command_line(spark, tmp_path):
    (tmp_path / "v.tif").write_bytes(write_tiff(video()))
    main([str(tmp_path / "v.tif"), "--filter", "--diameter", "7", "--minmass", "100", "--separation", "6", "--out", str(tmp_path / "found")])
    want = batch_file(spark, str(tmp_path / "v.tif"), 7, minmass=100, separation=6, search_range=9.0)
    assert spark.read.parquet(str(tmp_path / "found")).count() == want.count() > 0
    assert parsed([]).minmass == 800 and parsed(["--debug", "x.ets"]).debug


def test_each_video_has_its_own_mass_limit(spark):
    """A dim video beside a bright one keeps the particles that it has alone."""
    bright, dim = video(3).astype(np.float32) * 20, video(3).astype(np.float32)
    p = LabParams(object_size=7, sep=6, mean_multiplier=3.0)
    alone = [detections_of(frames_from_array(spark, a, n), p).count() for a, n in ((bright, "b"), (dim, "d"))]
    both = detections_of(frames_from_array(spark, bright, "b").union(frames_from_array(spark, dim, "d")), p).groupBy("video_id").count().collect()
    assert {r.video_id: r["count"] for r in both} == dict(zip("bd", alone, strict=True)) and min(alone) > 0


def test_calibrations_are_kept_by_content(spark, tmp_path, monkeypatch):
    from spotflow.plans import pipeline

    fitted = []
    monkeypatch.setattr(pipeline, "random_pixel_calibration", lambda frames: fitted.append(frames.count()) or (2.0 + len(fitted), 100.0))
    a = video()
    for name, data in (("a.tif", a), ("copy.tif", a), ("b.tif", a + 1)):
        (tmp_path / name).write_bytes(write_tiff(data))
    got = [pipeline.kept_calibration(spark, str(tmp_path / n), str(tmp_path / "cache")) for n in ("a.tif", "copy.tif", "b.tif", "a.tif")]
    assert got == [(3.0, 100.0), (3.0, 100.0), (4.0, 100.0), (3.0, 100.0)] and len(fitted) == 2


def test_pairs_of_videos(spark, tmp_path):
    for name in ("s0.tif", "s1.tif", "d0.tif", "d1.tif"):
        (tmp_path / name).write_bytes(write_tiff(video(4, seed=int(name[1]))))
    at = lambda *names: [str(tmp_path / n) for n in names]
    paths = extract_pairs(spark, at("s0.tif", "s1.tif"), at("d0.tif", "d1.tif"), str(tmp_path / "out"), params=TraceParams(static_fit=True))
    assert len(paths) == 6 and spark.read.csv(paths[0], header=True).count() > 0
    with pytest.raises(ValueError):
        extract_pairs(spark, at("s0.tif"), [], str(tmp_path / "out"))


def test_margin_and_bytes(spark):
    frames = frames_from_array(spark, video(1))
    near = batch(frames, 7, minmass=100, separation=6).toPandas()
    inner = batch(frames, 7, minmass=100, separation=6, margin=14).toPandas()
    assert 0 < len(inner) < len(near)
    px = to_bytes(frames).first().px
    assert max(px) == 255 and min(px) >= 0 and all(p == int(p) for p in px)


def test_batch_and_frame_split(spark, tmp_path):
    a = video()
    p = dict(minmass=100, separation=6, search_range=4.0, cpu_processed=True, sig_radius=3, bg_radius=6)
    whole = batch_array(spark, a, 7, **p)
    assert whole.columns == ["frame", "mass", "y", "x", "particle", "Rg", "ecc", "signal", "raw_mass", "raw_bg_median", "raw_mass_corrected"]
    rows = whole.collect()
    assert {r.particle for r in rows} == {0, 1, 2, 3} and len(rows) == 24
    (tmp_path / "v.TIF").write_bytes(write_tiff(a))
    key = lambda df: sorted((r.frame, round(r.y, 9), round(r.x, 9)) for r in df.collect())
    assert key(batch_file(spark, str(tmp_path / "v.TIF"), 7, **p)) == key(whole)
    frames = frames_from_array(spark, a)
    parts = batch(frames.where("frame < 3"), 7, **p).union(batch(frames.where("frame >= 3"), 7, **p))
    assert key(parts) == key(whole)


def test_tracker_and_experiments(spark, tmp_path):
    lab = LabParams(object_size=7, sep=6, mean_multiplier=2.0, search_range=4, memory=1, duration_filter=3, exp_types=("one",), exp_type_folders=(str(tmp_path),), save_path=str(tmp_path / "out"))
    frames = frames_from_array(spark, video())
    tracks, msds = tracker(frames, lab)
    rows = tracks.collect()
    assert {r.duration for r in rows} == {6} and {"red_int_corrected", "steplength"} <= set(tracks.columns)
    assert {round(r.time / 0.036) for r in msds.collect()} == {1, 2, 3, 4, 5}
    for n in ("a", "b"):
        (tmp_path / f"{n}.tif").write_bytes(write_tiff(video(seed=ord(n))))
    run_experiments(spark, lab, "r")
    saved = spark.read.parquet(str(tmp_path / "out" / "tracked"))
    assert {(r.experiment_type, r.replicate) for r in saved.select("experiment_type", "replicate").distinct().collect()} == {("one", 0), ("one", 1)}
    assert sweep(frames, [1.0, 3.0], [6], [7]).count() == 2


def test_extract_traces(spark):
    a = video()
    out = extract_traces(frames_from_array(spark, a[:2]), frames_from_array(spark, a))
    n = out["static"].count()
    assert n and out["traces"].count() == 6 * n and out["tracks"].count() > 0


def mounted(spark, name, folder):
    """A path with a scheme that only Hadoop knows."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{name}.link./data", f"file://{folder}")
    return f"viewfs://{name}/data"


def noting(folder, log):
    """Opens what lies behind the mount, and notes which bytes are read; other files can't be opened."""

    def open_file(uri):
        import os

        name = uri.rsplit("/", 1)[-1]
        if not name.startswith("open"):
            raise OSError(uri)

        def read(at, n):
            with open(os.path.join(log, f"{os.getpid()}"), "a") as note:
                note.write(f"{name} {at} {n}\n")
            with open(os.path.join(folder, name), "rb") as f:
                f.seek(at)
                return f.read(n)

        return read

    return open_file


def test_remote_files_are_read_by_ranges(spark, tmp_path):
    """One store holds files that workers can open, of which they read their own bytes, and some that only Spark can read."""
    data, log = tmp_path / "data", tmp_path / "log"
    data.mkdir()
    log.mkdir()
    a = (np.random.default_rng(0).random((9, 40, 50)) * 200).astype(np.uint16)
    (data / "open.tif").write_bytes(write_tiff(a))
    (data / "closed.tif").write_bytes(write_tiff(a + 1))
    path = mounted(spark, "videos", data)
    rows = read_tiff(spark, path, frames=2, open_file=noting(str(data), str(log))).collect()
    got = {(r.video_id.rsplit("/", 1)[-1], r.frame): r.px for r in rows}
    assert len(rows) == len(got) == 18 and all(got["open.tif", k] == a[k].ravel().tolist() and got["closed.tif", k] == (a[k] + 1).ravel().tolist() for k in range(9))
    reads = [line.split() for f in log.iterdir() for line in f.read_text().splitlines()]
    pixels = [int(n) for _, _, n in reads if int(n) == 4000]
    assert len(pixels) == 9 and sum(int(n) for _, _, n in reads) < 9 * 4000 + 9 * 400 and {r[0] for r in reads} == {"open.tif"}
    assert read_tiff(spark, path).count() == 18  # nobody but Spark opens them


def test_remote_channels_are_read_alone(spark, tmp_path):
    data, log = tmp_path / "data", tmp_path / "log"
    data.mkdir()
    log.mkdir()
    (data / "open.ets").write_bytes(write_ets({c: {f: np.full((16, 16), 10 * c + f) for f in range(3)} for c in (0, 1)}))
    path = mounted(spark, "channels", data)
    rows = read_ets(spark, path, channel=1, open_file=noting(str(data), str(log))).collect()
    assert sorted((r.frame, r.px[0]) for r in rows) == [(0, 10.0), (1, 11.0), (2, 12.0)]
    reads = [line.split() for f in log.iterdir() for line in f.read_text().splitlines()]
    assert sum(int(n) == 512 for _, _, n in reads) == 3  # of six chunks


def test_a_stream_of_frames_from_growing_files(spark, tmp_path):
    """Pages added later, half-written ones and new files are located once, over restarts."""
    from spotflow.operators.frames import locate
    from spotflow.params import TrackingParams
    from spotflow.streaming.frames import frame_stream

    folder = tmp_path / "in"
    folder.mkdir()
    a, b = video(6, seed=1), video(4, seed=2)

    def run():
        found = locate(frame_stream(spark, str(folder), frames=2), TrackingParams(7, minmass=100))
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.video_id.rsplit("/", 1)[-1], r.frame, r.seq) for r in rows)

    whole = lambda *files: sorted((name, r.frame, r.seq) for name, v in files for r in locate(frames_from_array(spark, v), TrackingParams(7, minmass=100)).collect())
    (folder / "a.tif").write_bytes(write_tiff(a[:3]))
    assert run() == whole(("a.tif", a[:3]))
    data = write_tiff(a)
    (folder / "a.tif").write_bytes(data[: len(data) - 500])  # the last page is half there
    (folder / "b.tif").write_bytes(write_tiff(b))
    assert run() == whole(("a.tif", a[:5]), ("b.tif", b))
    (folder / "a.tif").write_bytes(data)
    assert run() == whole(("a.tif", a), ("b.tif", b))
    assert run() == whole(("a.tif", a), ("b.tif", b))
