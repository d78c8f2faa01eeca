import numpy as np
import pytest

from spotflow.functions import imaging as im
from spotflow.functions.calibration import bessel_i1e, chi2_survival, fit_pixel, fit_spot
from spotflow.operators.frames import locate_frame
from spotflow.params import LabParams, TrackingParams, update_mm_and_sep, write_yaml

RAMP = np.add.outer(10.0 * np.arange(9), np.arange(9.0))


def spot_image(points, shape=(40, 50), seed=None):
    u, v = np.mgrid[: shape[0], : shape[1]]
    image = sum(h * np.exp(-((u - y) ** 2 + (v - x) ** 2) / 4.0) for y, x, h in points)
    return image if seed is None else image + np.random.default_rng(seed).random(shape)


def two_pixels():
    p = np.zeros((9, 9))
    p[4, 4], p[4, 5] = 100, 60
    return p


def test_bandpass_and_centroid_by_hand():
    out = im.bandpass(two_pixels(), 1.0, 3)
    assert out[4] == pytest.approx([0, 0, 0, 1.273029, 10.070702, 6.857160, 0.763818, 0, 0], abs=1e-6)
    assert np.flatnonzero(out[:, 4]).tolist() == [4]
    mass, c0, c1 = im.centres(out, 3)
    assert (mass[4, 4], c0[4, 4], c1[4, 4]) == pytest.approx((18.200891, 0, 0.306805), abs=1e-6)
    assert np.argwhere(im.maxima(out, 3) & (out > 0)).tolist() == [[4, 4]]


def test_native_roi_by_hand():
    at = lambda y, x, gap: [float(a[0]) for a in im.native_roi(RAMP, np.array([y]), np.array([x]), 1, 2, gap)]
    assert at(4.5, 4.4, 0) == [270, 54, 0]
    assert at(0.2, 0.4, 0.5) == [11, 11, -44]


def test_lab_roi_by_hand():
    a = im.lab_roi(RAMP, 4.5, 4.25, 2, 8, 1)
    assert (a["int"], a["bg"], a["sig_pixel_size"], a["int_corrected"]) == (294, 49.5, 6, -3)
    b = im.lab_roi(RAMP, 0.2, 0.4, 2, 8, 1)
    assert (b["int"], b["bg"], b["sig_pixel_size"], b["int_corrected"]) == (22, 20, 4, -58)


def test_maxima_against_windows():
    image = np.random.default_rng(1).integers(0, 9, (15, 17)).astype(float)
    for sep in (2, 3, 5):
        k = im.window_size(sep)
        a = int(k / 2 - 0.5)
        want = [[image[u, v] >= image[max(0, u - a) : u - a + k, max(0, v - a) : v - a + k].max() for v in range(17)] for u in range(15)]
        assert (im.maxima(image, sep) == np.array(want)).all()


def test_locate_finds_spots_and_is_translation_invariant():
    points = [(10.3, 12.6, 900), (25.8, 30.2, 700), (12.0, 38.4, 800)]
    found = locate_frame(spot_image(points), TrackingParams(7, minmass=50, separation=6, cpu_processed=True, sig_radius=3, bg_radius=6))
    got = sorted(zip(found["y"], found["x"], strict=True))
    assert np.allclose(got, sorted((y, x) for y, x, _ in points), atol=0.15)
    moved = locate_frame(spot_image([(y + 2, x + 3, h) for y, x, h in points]), TrackingParams(7, minmass=50, separation=6))
    assert np.allclose(sorted(zip(moved["y"] - 2, moved["x"] - 3, strict=True)), got, atol=1e-9)


def test_close_losers_against_all_pairs():
    rng = np.random.default_rng(2)
    y, x, m = rng.random(200) * 40 - 5, rng.random(200) * 40, rng.integers(0, 20, 200).astype(float)
    want = [any(j != i and (y[i] - y[j]) ** 2 + (x[i] - x[j]) ** 2 < 9 and (m[j] > m[i] or (m[j] == m[i] and j < i)) for j in range(200)) for i in range(200)]
    assert im.close_losers(y, x, m, 3.0).tolist() == want


def test_lab_regions_of_many_positions_at_once():
    rng = np.random.default_rng(4)
    image = rng.random((20, 30)) * 100
    y, x = np.append(rng.random(60) * 24 - 2, [0.0, -0.4, 40.0]), np.append(rng.random(60) * 34 - 2, [0.0, 29.9, 5.0])
    for radii in ((9, 60, 0), (8, 70, 2), (0.1, 0.2, 5)):
        got = im.lab_rois(image, y, x, *radii, chunk=17)
        for k in range(len(y)):
            want = im.lab_roi(image, y[k], x[k], *radii)
            assert {n: got[n][k] for n in want} == pytest.approx(want, nan_ok=True)
    assert im.row_medians(np.zeros((2, 0)), np.zeros((2, 0), bool)).tolist() == pytest.approx([np.nan] * 2, nan_ok=True)


def test_refinement_against_loops():
    image = spot_image([(10.3, 12.8, 500), (25.6, 30.2, 800), (3.0, 3.0, 300)])
    u, v = np.array([9, 27, 0, 20]), np.array([11, 31, 1, 5])
    image[16:25, 1:10] = 0
    got = im.refine(image, u, v, 3, 6)
    for k in range(len(u)):
        a, b = min(max(u[k], 3), image.shape[0] - 4), min(max(v[k], 3), image.shape[1] - 4)
        for step in range(7):
            cells = [(i, j, image[a + i, b + j]) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
            mass = sum(p for *_, p in cells)
            c = [sum(x[axis] * x[2] for x in cells) / mass if mass else 0.0 for axis in (0, 1)]
            moved = tuple(min(max(at + (int(np.sign(d)) if abs(d) > 0.6 else 0), 3), n - 4) for at, d, n in zip((a, b), c, image.shape, strict=True))
            if moved == (a, b) or step == 6:
                break
            a, b = moved
        assert (got[0][k], got[1][k], got[2][k], got[3][k]) == pytest.approx((a + c[0], b + c[1], mass, max(p for *_, p in cells)))


def test_parameters(tmp_path):
    for bad in ({"diameter": 4}, {"diameter": 5, "noise_size": 7}, {"diameter": 5, "bg_radius": 3}, {"diameter": 5, "max_iterations": 0}, {"diameter": 5, "smoothing_size": 4}):
        with pytest.raises(ValueError):
            TrackingParams(**bad)
    names = [n for n, _ in TrackingParams(5, search_range=3, cpu_processed=True, sig_radius=2, bg_radius=4, characterize=True).columns()]
    assert names == ["frame", "mass", "y", "x", "particle", "Rg", "ecc", "signal", "raw_mass", "raw_bg_median", "raw_mass_corrected", "Rg_gpu", "raw_mass_gpu", "signal_gpu", "ecc_gpu"]
    path = str(tmp_path / "p.yml")
    write_yaml(path, {"sep": 7, "exp_types": ["a", "b"], "pixel_size": 0.2, "other": "x"})
    p = LabParams.load(path, sep=9)
    assert (p.sep, p.exp_types, p.pixel_size, p.memory) == (9, ("a", "b"), 0.2, 1)
    with pytest.raises(ValueError):
        LabParams.load(nothing=1)
    with pytest.raises(ValueError):
        update_mm_and_sep(path, 1.5, 4)
    (tmp_path / "q.yml").write_text("# of the lab\nsep: 7 # pixels\nmean_multiplier: 0.8\nmemory: 2\n")
    update_mm_and_sep(str(tmp_path / "q.yml"), 1.5, 4)
    assert (tmp_path / "q.yml").read_text() == "# of the lab\nsep: 4 # pixels\nmean_multiplier: 1.5\nmemory: 2\n"


def test_special_functions():
    assert float(bessel_i1e(np.array(1.0))) == pytest.approx(0.2079104154, rel=1e-9)
    assert float(bessel_i1e(np.array(50.0))) == pytest.approx(0.0559931272, rel=1e-6)
    assert chi2_survival(3.841458821, 1) == pytest.approx(0.05, rel=1e-6) and chi2_survival(20.0, 10) == pytest.approx(0.0292527, rel=1e-5)


def test_camera_fit_recovers_gain_and_offset():
    rng = np.random.default_rng(3)
    n = rng.poisson(6.0, 6000)
    values = 100 + np.where(n > 0, rng.gamma(np.maximum(n, 1), 20.0), 0.0)
    gain, offset, _ = fit_pixel(values[n > 0])
    assert gain == pytest.approx(20, rel=0.2) and offset == pytest.approx(100, abs=20)


def test_spot_fit():
    u, v = np.mgrid[:15, :15]
    image = 50 * np.exp(-((u - 7.3) ** 2 + (v - 6.8) ** 2) / (2 * 1.7**2)) + 11
    assert fit_spot(image, 7, 7, 5) == pytest.approx((7.3, 6.8, 50, 1.7, 11), abs=1e-4)


def test_pixel_histograms_equal_the_series(spark):
    """Merged counts are numpy's histogram of each pixel's whole series, and give the same fit."""
    from spotflow.functions.calibration import fit_counts, pixel_histograms, random_pixel_calibration
    from spotflow.operators.frames import frames_from_array

    rng = np.random.default_rng(4)
    video = (100 + rng.gamma(6.0, 8.0, (500, 4, 5))).astype(np.float32)
    video[:, 0, 0] = 7.0
    video[3, 1, 1] = np.nan
    frames = frames_from_array(spark, video).repartition(5)
    rows = pixel_histograms(frames, 20).collect()
    assert sorted((r.u, r.v) for r in rows) == [(u, v) for u in range(4) for v in range(5) if (u, v) != (0, 0)]
    for r in rows:
        own = video[:, r.u, r.v].astype(float)
        own = own[~np.isnan(own)]
        counts, edges = np.histogram(own, 100)
        assert r.counts == counts.tolist() and np.allclose(r.edges, edges) and np.isclose(r.mean, own.mean()) and np.isclose(r["spread"], own.var())
        assert np.allclose(fit_counts(np.array(r.counts), np.array(r.edges), r.mean, r["spread"]), fit_pixel(own), rtol=1e-3, atol=1e-3)
    gain, offset = random_pixel_calibration(frames, 20, 0.0)
    assert np.isfinite(gain) and np.isfinite(offset)


@pytest.mark.parametrize(("tile", "spread"), [(17, True), (40, False), (1000, True)])
def test_tiles_of_any_size_give_the_same(spark, tile, spread):
    """Band pass and detections of whole frames, from tiles with halos."""
    from spotflow.operators import tiles
    from spotflow.operators.frames import bandpassed, frames_from_array, locate, pixels
    from spotflow.params import TrackingParams

    rng = np.random.default_rng(2)
    spots = [(float(y), float(x), 400.0) for y, x in rng.random((60, 2)) * [110, 130]]
    frames = frames_from_array(spark, np.stack([spot_image(spots, shape=(110, 131), seed=k) for k in range(2)]))
    for replicate in (False, True):
        got = tiles.tile_pixels(tiles.bandpassed_tiles(frames, 1, 5, 0.5, replicate, tile, spread)).collect()
        want = pixels(bandpassed(frames, 1, 5, 0.5, replicate)).collect()
        assert {(r.frame, r.u, r.v): r.p for r in got} == {(r.frame, r.u, r.v): r.p for r in want} and len(got) == len(want)
    params = TrackingParams(7, minmass=50, separation=6, cpu_processed=True, characterize=True, sig_radius=3, bg_radius=6)
    got, want = tiles.locate_tiles(frames, params, tile, spread).collect(), locate(frames, params).collect()
    clean = lambda rows: sorted(tuple(v if isinstance(v, (str, int)) else None if v is None or v != v else round(v, 9) for k, v in r.asDict().items() if k != "seq") for r in rows)
    assert clean(got) == clean(want) and len(want) > 40
    order = lambda rows: [(r.frame, round(r.y, 9), round(r.x, 9)) for r in sorted(rows, key=lambda r: (r.frame, r.seq))]
    assert order(got) == order(want)
    with pytest.raises(ValueError):
        tiles.locate_tiles(frames, TrackingParams(7, topn=3))


def test_chunks_of_frames(spark):
    from spotflow.operators.frames import frames_from_array, map_chunks

    video = np.random.default_rng(8).random((7, 3, 4)).astype(np.float32)
    frames = frames_from_array(spark, video).repartition(3).where("frame <> 4")
    less = map_chunks(frames, lambda a: a - a.mean(axis=0), 3).collect()
    kept = [0, 1, 2, 3, 5, 6]
    for r in less:
        own = [k for k in kept if k // 3 == r.frame // 3]
        assert np.allclose(r.px, (video[r.frame].astype(float) - video[own].astype(float).mean(axis=0)).ravel())
    assert sorted(r.frame for r in less) == kept
    halves = map_chunks(frames, lambda a: a[:, ::2], 2).first()
    assert (halves.nrows, halves.ncols, len(halves.px)) == (2, 4, 8)
    with pytest.raises(Exception, match="as many frames"):
        map_chunks(frames, lambda a: a[:1], 3).collect()


def test_profiles_of_many_videos_at_once(spark):
    """Each video is corrected as it would be alone."""
    from spotflow.operators.frames import frames_from_array, illumination_corrected, illumination_corrected_by_video

    rng = np.random.default_rng(6)
    videos = {"a": 50 + 9 * rng.random((4, 8, 9)), "b": 20 + 40 * rng.random((3, 6, 5))}
    tables = {k: frames_from_array(spark, v.astype(np.float32), k) for k, v in videos.items()}
    got = {(r.video_id, r.frame): r.px for r in illumination_corrected_by_video(tables["a"].union(tables["b"]), 1.5, 2.0, 3.0).collect()}
    for k, t in tables.items():
        for r in illumination_corrected(t, 1.5, 2.0, 3.0).collect():
            assert np.allclose(got[k, r.frame], r.px, rtol=1e-9)
    assert len(got) == 7


def test_tiles_of_a_batch_go_on_together():
    """Nine tiles of each of two frames are one batch, not eighteen."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

    from spotflow.operators.tiles import tiled

    class Table:
        schema = StructType().add("video_id", StringType()).add("frame", IntegerType()).add("nrows", IntegerType()).add("ncols", IntegerType()).add("px", ArrayType(DoubleType()))
        columns = schema.names

        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            self.fn = fn
            return self

    batch = pa.record_batch({"video_id": ["a", "b"], "frame": pa.array([1, 2], pa.int32()), "nrows": pa.array([8, 8], pa.int32()), "ncols": pa.array([8, 8], pa.int32()), "px": [[float(k) for k in range(64)]] * 2})
    (made,) = tiled(Table(), 3, 1, spread=False).fn([batch])
    assert made.num_rows == 18 and made.column("video_id").to_pylist() == ["a"] * 9 + ["b"] * 9
    assert made.column("px").to_pylist()[0] == [float(8 * u + v) for u in range(4) for v in range(4)]
