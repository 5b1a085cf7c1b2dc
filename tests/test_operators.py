"""Edge cases of the operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import display, stats
from pixelloom.operators import background, calibration, geometry, mosaic, neighbours, postprocess, psf, quality, registration, sets, stacking
from pixelloom.plans import pipeline, session
from pixelloom.sources import fits, headers, images
from pixelloom.streaming import live

PX = "stack_id int, frame_id int, y int, x int, c int, v double"


def pixels(spark, frames):
    """(frames, h, w[, c]) array as pixels, NaN as NULL."""
    a = np.asarray(frames, float)
    a = a[..., None] if a.ndim == 3 else a
    rows = [(0, f, y, x, c, None if np.isnan(v) else float(v)) for (f, y, x, c), v in np.ndenumerate(a)]
    return spark.createDataFrame([tuple(map(int, r[:5])) + (r[5],) for r in rows], PX)


def image(df, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = np.nan if r["v"] is None else r["v"]
    return out


@pytest.fixture(scope="module")
def cube():
    rng = np.random.default_rng(3)
    a = rng.normal(10, 1, (7, 4, 5))
    a[0, 0, 0] = 1e4
    a[:, 1, 1] = 5.0
    a[:, 2, 2] = np.nan
    a[:6, 3, 3] = np.nan
    return a


@pytest.mark.parametrize("method", sorted(stacking.METHODS))
def test_missing_pixels_are_null(spark, cube, method):
    out = image(stacking.stack(pixels(spark, cube), method), 4, 5)
    assert np.isnan(out[2, 2]) and out[1, 1] == 5.0 and out[3, 3] == pytest.approx(cube[6, 3, 3])


def test_outlier_is_rejected_before_any_method(spark, cube):
    px = pixels(spark, cube)
    assert image(stacking.stack(px, "max"), 4, 5)[0, 0] < 100
    assert image(stacking.stack(px, "max", prereject=False), 4, 5)[0, 0] == 1e4
    assert image(stacking.stack(px.filter("frame_id < 2"), "max"), 4, 5)[0, 0] == 1e4  # under 3 frames nothing is rejected


@pytest.mark.parametrize(("method", "params"), [
    ("median", {}), ("percentile_clip", {"low": 20, "high": 30}), ("percentile_clip", {"low": 50, "high": 50, "prereject": False}), ("weighted", {}),
    ("sigma_clip", {"prereject": False, "rounds": 2}), ("winsorised", {"prereject": False, "rounds": 2}), ("max", {"prereject": False}),
])
def test_deep_stacks_are_as_shallow_ones(spark, method, params):
    rng = np.random.default_rng(8)
    a = np.round(rng.normal(10, 2, (40, 2, 3)), 1)  # with ties
    a[rng.random(a.shape) < 0.1] = np.nan
    a[3, 0, 0], a[:, 1, 1], a[:, 0, 2], a[5:, 1, 2] = 1e4, 5.0, np.nan, np.nan
    a[::4, 0, 1] += 9
    px = pixels(spark, a)
    px = px.unionByName(px.filter("frame_id < 2").withColumn("stack_id", F.lit(1)))  # one stack of each kind
    if method == "weighted":
        params = {"weights": px.select("stack_id", "frame_id").distinct().withColumn("w", F.col("frame_id") + 0.5)}
    want, got = ({tuple(r)[:4]: r.v for r in stacking.stack(px, method, most_frames=most, **params).collect()} for most in (1 << 20, 10))
    assert len(want) == (10 if method == "weighted" else 12) and got == pytest.approx(want)


def test_sigma_clip_with_no_spread_keeps_the_median(spark):
    a = np.ones((5, 1, 1))
    a[4] = 3
    assert image(stacking.stack(pixels(spark, a), "sigma_clip", prereject=False), 1, 1)[0, 0] == 1


def test_trimmed_mean_takes_the_median_where_cuts_meet(spark):
    a = np.array([1.0, 2, 30, 4]).reshape(4, 1, 1)
    out = stacking.stack(pixels(spark, a), "percentile_clip", prereject=False, low=50, high=50)
    assert image(out, 1, 1)[0, 0] == 3


def test_zero_weights_give_zero(spark):
    weights = spark.createDataFrame([(0, f, 0.0) for f in range(3)], "stack_id int, frame_id int, w double")
    assert image(stacking.stack(pixels(spark, np.ones((3, 1, 1))), "weighted", weights=weights), 1, 1)[0, 0] == 0


def test_unknown_names_are_errors(spark):
    px = pixels(spark, np.ones((1, 2, 2)))
    with pytest.raises(ValueError):
        stacking.stack(px, "mode")
    with pytest.raises(ValueError):
        neighbours.site_colour(F.col("y"), F.col("x"), "XYZW")
    with pytest.raises(ValueError):
        calibration.combine(px, "mode")


def test_flat_of_no_light_is_an_error(spark):
    with pytest.raises(Exception, match="not positive"):
        calibration.master_flat(pixels(spark, -np.ones((1, 2, 2)))).collect()


def test_mono_dark_serves_a_colour_light(spark):
    light = pixels(spark, np.full((1, 2, 2, 3), 5.0))
    dark = calibration.combine(pixels(spark, np.full((1, 2, 2), 2.0))).drop("c")
    assert {r.v for r in calibration.calibrate(light, dark).collect()} == {3.0}


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], PX)
    for df in (stacking.stack(none), stacking.drizzle(none), neighbours.gaussian_blur(none, (8, 8), 1.0), background.auto_balance(none, (8, 8)), geometry.auto_crop(none), postprocess.denoise(none)):
        assert df.count() == 0


def test_blur_reflects_beyond_small_sides(spark):
    a = np.arange(12.0).reshape(1, 3, 4)
    out = image(neighbours.gaussian_blur(pixels(spark, a), (3, 4), 5.0), 3, 4)
    assert out.mean() == pytest.approx(a.mean()) and np.ptp(out) < np.ptp(a)
    assert neighbours.reflect(-1, 3) == 0 and neighbours.reflect(3, 3) == 2 and neighbours.reflect(-7, 3) == 0


def test_cubic_zoom_keeps_grid_points_and_lines(spark):
    for n, to in ((2, 5), (6, 64), (50, 33), (300, 40)):
        sparse, dense = np.zeros((to, n)), np.zeros((n, n))
        for (i, j), x in neighbours.cubic_weights(n, to).items():
            sparse[i, j] = x
        own = neighbours.cubic_weights(n, n)  # at the places themselves the spline is the value
        for (i, j), x in own.items():
            dense[i, j] = x
        assert np.abs(dense - np.eye(n)).max() < 1e-12 and np.allclose(sparse.sum(1), 1) and len(own) <= n * (4 + 2 * neighbours.SPLINE_REACH)
    w = neighbours.cubic_weights(5, 9)
    line = [sum(w[i, j] * j for j in range(5)) for i in range(9)]
    assert line[::2] == pytest.approx(list(range(5)))
    assert [sum(w[i, j] for j in range(5)) for i in range(9)] == pytest.approx([1] * 9)


def test_crop_without_valid_pixels_changes_nothing(spark):
    px = pixels(spark, np.zeros((1, 4, 4)))
    assert geometry.auto_crop(px).count() == 16 and geometry.crop(px, 0, 0, 4, 4).count() == 16


def test_scores_with_infinite_widths(spark):
    rows = [(0, float("inf"), 0.0, 1.0), (1, 2.0, 0.1, 0.9), (2, 2.1, 0.1, 0.9)]
    frames = spark.createDataFrame(rows, "frame_id int, fwhm double, eccentricity double, roundness double")
    assert all(r.keep for r in quality.score_frames(frames).collect())  # fewer than 3 finite widths
    assert {r.frame_id: r.w for r in quality.psf_weights(frames).collect()}[0] == 0
    more = frames.unionAll(spark.createDataFrame([(3, 2.2, 0.1, 0.9)], frames.schema))
    assert [r.frame_id for r in quality.score_frames(more).filter("not keep").collect()] == [0]


def stars_at(places, h=64, w=64, sigma=1.8):
    y, x = np.mgrid[:h, :w]
    return 0.05 + sum(a * np.exp(-0.5 * ((x - sx) ** 2 + (y - sy) ** 2) / sigma**2) for sx, sy, a in places)


PLACES = [(12, 14, 0.9), (40, 11, 0.8), (25, 30, 0.7), (50, 45, 0.6), (14, 50, 0.85), (34, 52, 0.5), (52, 24, 0.75)]


def test_star_width_is_recovered(spark):
    found = psf.frame_psf(pixels(spark, stars_at(PLACES)[None]).drop("c"), (64, 64)).first()
    assert found.n_stars >= 6 and found.fwhm == pytest.approx(1.8 * 2.3548, rel=0.02)


def test_shift_and_turn_are_recovered(spark):
    t, shift = np.radians(4), np.array([3.0, -2.0])
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    moved = [(*(turn @ np.array(p[:2]) + shift), p[2]) for p in PLACES]
    frames = pixels(spark, [stars_at(PLACES), stars_at(moved)])
    good, errors = registration.align_frames(frames, (64, 64))
    out = image(good.filter("frame_id = 1"), 64, 64)
    inside = np.isfinite(out)
    assert errors.count() == 0 and inside.mean() > 0.8
    assert np.abs(out - stars_at(PLACES))[inside].max() < 0.12


def test_frame_without_stars_becomes_an_error(spark):
    good, errors = registration.align_frames(pixels(spark, [stars_at(PLACES), np.zeros((64, 64))]), (64, 64))
    assert [r.frame_id for r in errors.collect()] == [1] and {r.frame_id for r in good.select("frame_id").distinct().collect()} == {0}


def test_denoise_in_tiles_equals_denoise_in_one(spark):
    a = np.random.default_rng(1).normal(1, 0.1, (1, 40, 40))
    px = pixels(spark, a)
    one, tiled = image(postprocess.denoise(px, tile=64), 40, 40), image(postprocess.denoise(px, tile=20), 40, 40)
    assert np.allclose(one[9:-9, 9:-9], tiled[9:-9, 9:-9]) and one.std() < a.std()


def test_nl_means_against_the_definition():
    a = np.random.default_rng(4).normal(size=(9, 10))
    h, patch, search = 0.8, postprocess.PATCH, postprocess.SEARCH
    wide = np.pad(a, patch + search, mode="symmetric")
    want = np.zeros_like(a)
    at = lambda y, x: wide[y + search : y + search + 2 * patch + 1, x + search : x + search + 2 * patch + 1]
    for y, x in np.ndindex(a.shape):
        total = weight = 0.0
        for dy in range(-search, search + 1):
            for dx in range(-search, search + 1):
                w = np.exp(-((at(y, x) - at(y + dy, x + dx)) ** 2).mean() / h**2)
                total, weight = total + w * wide[y + dy + patch + search, x + dx + patch + search], weight + w
        want[y, x] = total / weight
    assert np.allclose(postprocess.nl_means(a, h), want)


def test_unknown_strength_counts_as_one(spark):
    px = pixels(spark, np.random.default_rng(1).normal(1, 0.1, (1, 12, 12)))
    assert np.allclose(image(postprocess.denoise(px, "none such"), 12, 12), image(postprocess.denoise(px, "medium"), 12, 12))


def test_ranks_of_large_groups_are_exact(spark):
    rng = np.random.default_rng(6)
    groups = {0: rng.normal(size=3000), 1: np.round(rng.normal(size=2001), 1), 2: np.array([5.0]), 3: np.full(400, 2.0), 4: np.r_[rng.normal(size=999), 1e12]}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (9, None)], "k int, v double")
    got = {r.k: r.ranked for r in stats.medians(rows, ["k"], "v").collect()}
    assert got == {k: pytest.approx(np.median(v)) for k, v in groups.items()}
    spread = {r.k: r.sigma for r in stats.mad_sigmas(rows, ["k"], "v").collect()}
    assert spread == {k: pytest.approx(1.4826 * np.median(np.abs(v - np.median(v)))) for k, v in groups.items()}
    low = {r.k: r.pedestal for r in background.kth_smallest(rows, ["k"]).collect()}
    assert low == {k: np.sort(v)[len(v) // 1000] for k, v in groups.items()}


@pytest.mark.parametrize("dense", [1 << 22, 0])
def test_filters_of_lines_against_numpy(spark, dense, monkeypatch):
    monkeypatch.setattr(neighbours, "DENSE_WEIGHTS", dense or 1)
    a = np.random.default_rng(7).normal(size=(9, 14))
    a[3, 4:8] = np.nan
    weights = neighbours.folded(14, neighbours.gaussian_taps(1.3))
    w = np.zeros((14, 14))
    for (i, j), x in weights.items():
        w[i, j] = x
    good = np.isfinite(a)
    want = (np.where(good, a, 0) @ w.T) / (good @ w.T)
    assert np.allclose(image(neighbours.along(pixels(spark, a[None]), "x", weights), 9, 14), want)
    strict = image(neighbours.along(pixels(spark, a[None]), "x", weights, strict=True), 9, 14)
    assert np.isnan(strict[3]).any() and np.allclose(strict[0], want[0])


def test_stretch_of_images_without_a_range(spark):
    flat = display.stretch_params(pixels(spark, np.ones((1, 3, 3))), ["stack_id"]).first()
    none = display.stretch_params(pixels(spark, np.full((1, 3, 3), np.nan)), ["stack_id"]).first()
    assert (flat.shadow, flat.high, flat.midtone) == (1, 1, 0.25) and (none.shadow, none.high, none.midtone) == (0, 1, 0.25)


def test_known_numbers_of_frames(spark, cube):
    known = spark.createDataFrame([(0, 7)], "stack_id int, frames long")
    px = pixels(spark, cube)
    assert sorted(map(str, stacking.stack(px, "max", frames=known).collect())) == sorted(map(str, stacking.stack(px, "max").collect()))


def test_fits_round_trip(spark, tmp_path):
    for shape in ((6, 5), (4, 7, 3)):
        a = np.random.default_rng(2).normal(size=shape).astype(np.float32)
        header, back = fits.read_image(fits.write_image(a, {"OBJECT": "it's M31", "EXPTIME": 1.5}))
        assert np.array_equal(back.squeeze(), a) and header["OBJECT"] == "it's M31" and header["EXPTIME"] == 1.5
    fits.register(spark)
    heads = F.create_map(F.lit("OBJECT"), F.lit("M31"), F.lit("GAIN"), F.lit("1.5"), F.lit("NAXIS1"), F.lit("99"))
    px = pixels(spark, np.arange(36.0).reshape(3, 3, 4)).withColumn("path", F.concat(F.lit("/x/"), "frame_id", F.lit(".fits"))).withColumn("header", heads)
    px.filter("not (y = 1 and x > 1) and not (y = 0 and x = 0 and frame_id = 1)").repartition(5).createOrReplaceTempView("holes")
    out = str(tmp_path / "out")
    fits.save_images(spark.table("holes"), out)
    for back in (spark.read.format("fits").load(out), fits.read_stored(spark, out)):
        got = {(r.path[-6], r.y, r.x): r.v for r in back.collect()}
        assert got == {(str(f), y, x): None if (y == 1 and x > 1) or (y, x, f) == (0, 0, 1) else 12.0 * f + 4 * y + x for f in range(3) for y in range(3) for x in range(4)}
        assert [(h.header["OBJECT"], h.header["GAIN"], h.header["NAXIS1"]) for h in back.filter("header is not null").collect()] == [("M31", "1.5", "4")] * 3
    assert images.collect_files(spark, out).count() == 3 and sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["0.fits", "1.fits", "2.fits", "_temporary"]
    headers.patch_headers(spark.createDataFrame([("1.fits", {"OBJECT": "M33", "CRVAL1": "10.5"})], "path string, extra map<string,string>"), out)
    heads = {h.path[-6]: h.header for h in fits.read_stored(spark, out).filter("header is not null").collect()}
    assert heads["1"]["OBJECT"] == "M33" and float(heads["1"]["CRVAL1"]) == 10.5 and heads["1"]["GAIN"] == "1.5" and heads["0"]["OBJECT"] == "M31"
    with pytest.raises(ValueError):
        fits.read_image(b"nothing")
    with pytest.raises(ValueError, match="unsupported"):
        images.save_image(px, f"{out}/x.tiff")


def test_an_image_dealt_to_two_tasks_is_refused_and_leaves_nothing(spark, tmp_path):
    fits.register(spark)
    px = pixels(spark, np.arange(12.0).reshape(1, 3, 4)).select(F.lit("a.fits").alias("path"), F.lit(None).cast("map<string,string>").alias("header"), F.lit(3).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("channels"), "y", "x", "c", "v")
    with pytest.raises(Exception, match="two tasks"):
        px.repartitionByRange(2, "y").sortWithinPartitions("y", "x").write.format("fits").mode("append").save(str(tmp_path / "two"))
    assert not list((tmp_path / "two").rglob("*.fits"))
    with pytest.raises(Exception, match="out of order"):
        px.coalesce(1).sortWithinPartitions(F.desc("y")).write.format("fits").mode("append").save(str(tmp_path / "bad"))


def test_session_runs_from_files_to_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    sky = stars_at(PLACES)
    save = lambda a, name: (tmp_path / name).write_bytes(fits.write_image(a.astype(np.float32)))
    for i in range(3):
        save(sky * 2 + 0.1, f"light{i}.fits")
        save(np.full((64, 64), 0.1) + rng.normal(0, 1e-4, (64, 64)), f"dark{i}.fits")
        save(np.full((64, 64), 0.5), f"flat{i}.fits")
    paths = lambda kind, *more: [str(tmp_path / f"{kind}{i}.fits") for i in range(3)] + list(more)
    text = session.save({"light_paths": paths("light", "/gone/away.fits"), "dark_paths": paths("dark"), "flat_paths": paths("flat"), "stacking_method": "median", "output_path": "done.fits"})
    settings = session.load(text)
    assert list(settings) == list(session.FIELDS) and len(settings) == 25 and session.load("{}") == session.FIELDS and session.load('{"sigma_low": 3, "drizzle": "x"}')["sigma_low"] == 3
    out = session.run_session(spark, settings, align=False)
    assert out == str(tmp_path / "done.fits") and (tmp_path / "master_dark.fits").exists() and (tmp_path / "master_flat.fits").exists()
    _, image = fits.read_image((tmp_path / "done.fits").read_bytes())
    assert np.abs(image[:, :, 0] - sky * 2).max() < 0.2
    again = session.run_session(spark, {**settings, "master_dark_path": str(tmp_path / "master_dark.fits"), "dark_paths": [], "output_path": str(tmp_path / "again.fits")}, align=False)
    assert np.allclose(fits.read_image(open(again, "rb").read())[1], image, atol=1e-5)
    with pytest.raises(ValueError, match="light frame"):
        session.run_session(spark, session.load("{}"))


def test_mosaic_from_files_to_a_file(spark, tmp_path):
    a = np.arange(40 * 60, dtype=np.float32).reshape(40, 60) / 100 + 1
    wcs = lambda crpix1: {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRPIX1": crpix1, "CRPIX2": 20.0, "CRVAL1": 100.0, "CRVAL2": 0.0, "CDELT1": -0.001, "CDELT2": 0.001}
    (tmp_path / "p0.fits").write_bytes(fits.write_image(a[:, :40], wcs(30.0)))
    (tmp_path / "p1.fits").write_bytes(fits.write_image(a[:, 20:], wcs(10.0)))
    mosaic.mosaic_files(spark, [str(tmp_path / f"p{i}.fits") for i in (0, 1)], str(tmp_path / "out" / "m.fits"))
    header, image = fits.read_image((tmp_path / "out" / "m.fits").read_bytes())
    assert header["CTYPE1"] == "RA---TAN" and image.shape[1] > 55 and (image == 0).any()
    # the same sky position has the same value, as the image is linear in x and y
    x = (100.0 - header["CRVAL1"]) / header["CD1_1"] + header["CRPIX1"] - 1
    y = (0.0 - header["CRVAL2"]) / header["CD2_2"] + header["CRPIX2"] - 1
    near = [image[int(np.floor(y)) + j, int(np.floor(x)) + i, 0] for j in (0, 1) for i in (0, 1)]
    fx, fy = x - np.floor(x), y - np.floor(y)
    assert (1 - fy) * ((1 - fx) * near[0] + fx * near[1]) + fy * ((1 - fx) * near[2] + fx * near[3]) == pytest.approx(a[19, 29], abs=0.02)
    (tmp_path / "p2.fits").write_bytes(fits.write_image(a))
    with pytest.raises(Exception, match="no valid celestial"):
        mosaic.panels_of(fits.read_stored(spark, str(tmp_path / "p2.fits")))[1].collect()


def test_two_stacks_with_the_same_frame_ids(spark):
    one = pixels(spark, np.ones((4, 2, 2)))
    px = one.unionAll(one.withColumn("stack_id", F.lit(1)))
    scores = spark.createDataFrame([(s, f, 2.0 + 0.1 * f + (9.0 if (s, f) == (1, 3) else 0), 0.1, 0.9) for s in (0, 1) for f in range(4)], "stack_id int, frame_id int, fwhm double, eccentricity double, roundness double")
    judged = quality.score_frames(scores, sigma=1.5)
    assert {(r.stack_id, r.frame_id) for r in judged.filter("not keep").collect()} == {(1, 3)}
    assert quality.accepted(px, quality.guarded(judged)).count() == 28 and quality.rejected(px, judged).count() == 4
    assert stacking.stack(px, "weighted", weights=quality.psf_weights(judged)).count() == 8
    dark = calibration.combine(one.withColumn("v", F.lit(0.5)))
    assert calibration.calibrate(px, dark).count() == px.count() and calibration.dark_scale(px, dark).count() == 8


def test_corner_glow_goes_and_the_centre_stays(spark):
    a = np.ones((1, 100, 100))
    y, x = np.mgrid[:100, :100]
    a[0] += 3 * np.exp(-(y + x) / 10) + np.exp(-0.5 * ((y - 50) ** 2 + (x - 50) ** 2) / 9)
    out = image(background.clean_corners(pixels(spark, a), (100, 100)), 100, 100)
    assert np.array_equal(out[30:70, 30:70], a[0, 30:70, 30:70]) and out[:20, :20].max() < 2.5 and np.median(out[:20, :20]) < 0.1 and out.min() >= 0
    small = background.clean_corners(pixels(spark, np.ones((1, 20, 20))), (20, 20))
    assert small.count() == 400 and small.agg(F.min("v")).first()[0] == 0.0


def test_integer_fits_with_scale_and_blank():
    cards = [fits._card(k, v) for k, v in {"SIMPLE": True, "BITPIX": 16, "NAXIS": 2, "NAXIS1": 2, "NAXIS2": 1, "BZERO": 32768, "BSCALE": 1, "BLANK": -5}.items()]
    head = (b"".join(cards) + b"END".ljust(80)).ljust(2880)
    _, a = fits.read_image(head + np.array([-5, 7], ">i2").tobytes().ljust(2880, b"\0"))
    assert np.isnan(a[0, 0, 0]) and a[0, 1, 0] == 32775


def test_one_panel_is_no_mosaic(spark):
    panels = spark.createDataFrame([(0, 4, 4, [2.0, 2.0], [10.0, 0.0], [-0.1, 0.0, 0.0, 0.1])], "panel_id int, width int, height int, crpix array<double>, crval array<double>, cd array<double>")
    with pytest.raises(Exception, match="at least 2"):
        mosaic.output_grid(panels).collect()


def test_grid_around_right_ascension_zero(spark):
    rows = [(i, 11, 11, [6.0, 6.0], [ra, 0.0], [-0.1, 0.0, 0.0, 0.1]) for i, ra in enumerate((359.8, 0.4))]
    panels = spark.createDataFrame(rows, "panel_id int, width int, height int, crpix array<double>, crval array<double>, cd array<double>")
    assert mosaic.output_grid(panels).first().o_width < 30


def test_ordered_sets(spark):
    have = spark.createDataFrame([("a",), ("b",)], "k string")
    new = spark.createDataFrame([("b", 0), ("c", 1), ("c", 2)], "k string, n int")
    assert [tuple(r) for r in sets.append_new(have, new, "k", "n").collect()] == [("c", 1)]


def test_whole_pipeline(spark):
    rng = np.random.default_rng(5)
    lights = pixels(spark, [stars_at(PLACES) + rng.normal(0, 0.002, (64, 64)) for _ in range(4)])
    config = pipeline.Config(method="sigma_clip", gradient=True, sharpen="light", star_reduction=0.3, crop=True, reject=True, align=True)
    out = pipeline.run(lights, (64, 64), config)
    assert 0 < out.count() <= 64 * 64 and out.filter("v < 0").count() == 0
    assert pipeline.run(lights, (64, 64), pipeline.Config(drizzle=True)).count() == 128 * 128
    assert pipeline.run(lights, (64, 64), pipeline.Config(method="weighted")).count() == 64 * 64


def test_live_stack_equals_batch(spark, tmp_path):
    px = pixels(spark, np.random.default_rng(0).normal(size=(5, 3, 3))).withColumn("frame_id", F.col("frame_id").cast("long"))
    for f in range(5):
        px.filter(F.col("frame_id") == f).coalesce(1).write.parquet(str(tmp_path / "in" / str(f)))
    stream = spark.readStream.schema(live.PX).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    live.run_to_folder(stream, str(tmp_path / "live"), str(tmp_path / "ckpt")).awaitTermination(120)
    got = {(r.y, r.x): r.v for r in live.latest(spark, str(tmp_path / "live")).collect()}
    want = {(r.y, r.x): r.v for r in stacking.stack(px, "mean", prereject=False).collect()}
    assert got == pytest.approx(want)
    # merged after each two batches: one batch is left of the first four, and a fifth
    slow = spark.readStream.schema(live.PX).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_to_folder(slow, str(tmp_path / "merged"), str(tmp_path / "ckpt2"), merge_every=2).awaitTermination(180)
    assert sorted(p.name for p in (tmp_path / "merged").iterdir()) == ["batch=3", "batch=4"]
    assert {(r.y, r.x): r.v for r in live.latest(spark, str(tmp_path / "merged")).collect()} == pytest.approx(want)
    # a merge that broke off after it was written is ended by the batch that is repeated
    (tmp_path / "merged/batch=4").rename(tmp_path / "merged/_merged-4")
    assert live._finish(str(tmp_path / "merged")) == 4 and [p.name for p in (tmp_path / "merged").iterdir()] == ["batch=4"]


def test_carried_columns_stay_with_their_pixels(spark):
    rows = [(0, 0, y, x, 0, None if (y, x) == (2, 2) else float(y * x), f"{y}-{x}") for y in range(4) for x in range(5) if (y, x) != (1, 1)]
    px = spark.createDataFrame(rows, "stack_id int, frame_id int, y int, x int, c int, v double, name string").withColumn("own", F.struct("name", "v"))
    got = {(r["y"], r["x"]): r["own"] for r in neighbours.gaussian_blur(px, (4, 5), 1.0, carry="own").collect()}
    assert got[1, 1] is None and len(got) == 20
    assert all(got[y, x] == (name, v) for _, _, y, x, _, v, name in rows)
    assert [(r["name"], r["v"]) for r in neighbours.local_maxima(px.drop("own"), (4, 5), 1, 0.0).collect()] == []
    peak = px.drop("own").withColumn("v", F.when((F.col("y") == 2) & (F.col("x") == 2), 9.0).otherwise(F.col("v")))
    assert [(r["name"], r["v"]) for r in neighbours.local_maxima(peak, (4, 5), 1, 0.0).collect()] == [("2-2", 9.0)]


@pytest.mark.parametrize(
    "values, want", [([5.0], 5.0), ([1.0, 2.0], 1.5), ([3.0] * 70 + [1.0] * 10, 3.0), ([float(i * 37 % 101) for i in range(101)], 50.0), ([0.0, float("nan"), 1.0], 1.0)]
)
def test_medians_of_few_and_many_values(spark, values, want):
    rows = spark.createDataFrame([(1, v) for v in [*values, None]], "k int, v double")
    assert stats.medians(rows, ["k"], "v").first()["ranked"] == want


@pytest.mark.parametrize("seed", range(6))
def test_star_fits_are_least_squares(seed):
    """Without noise the star that was made is found; with noise no step away from the fit has less residue."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:25, :25].astype(float)

    def star(x0, y0, fx, fy, a, b, t):
        u, v = np.cos(t) * (x - x0) + np.sin(t) * (y - y0), np.cos(t) * (y - y0) - np.sin(t) * (x - x0)
        return b + a * np.exp(-4 * np.log(2) * ((u / fx) ** 2 + (v / fy) ** 2))

    made = (12 + rng.uniform(-1, 1), 12 + rng.uniform(-1, 1), rng.uniform(4.5, 6), rng.uniform(3, 4), rng.uniform(0.5, 1), 0.1, rng.uniform(-0.7, 0.7))
    x0, y0, fx, fy, fwhm, ecc, _, a, b, _ = psf.fit_gaussian(star(*made))
    assert (x0, y0, fx, fy, a, b) == pytest.approx(made[:6], rel=1e-4)
    assert fwhm == pytest.approx(np.sqrt(made[2] * made[3]), rel=1e-4) and ecc == pytest.approx(np.sqrt(1 - (made[3] / made[2]) ** 2), rel=1e-3)
    noisy = star(*made) + rng.normal(0, 0.01, x.shape)
    x0, y0, fx, fy, _, _, _, a, b, t = psf.fit_gaussian(noisy)
    found = min(([x0, y0, fx, fy, a, b, angle] for angle in (t, t + np.pi / 2)), key=lambda p: ((noisy - star(*p)) ** 2).sum())  # widths come sorted
    least = ((noisy - star(*found)) ** 2).sum()
    assert least <= ((noisy - star(*made)) ** 2).sum()
    for k in range(7):
        for step in (-1e-2, -1e-3, 1e-3, 1e-2):
            other = [*found]
            other[k] += step
            assert ((noisy - star(*other)) ** 2).sum() > least


def test_other_header_is_made_once(spark):
    """The keys of the other header are not made again for each key of the first."""
    from pixelloom.functions import astrometry

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        calls.add(1)
        return str(x)

    first = F.create_map(*[F.lit(x) for i in range(15) for x in (f"K{i}", "old")])
    out = spark.range(4).select(astrometry.merged(first, F.create_map(F.lit("K3"), told("id"))).alias("m")).collect()
    assert [r.m["K3"] for r in out] == ["0", "1", "2", "3"] and all(len(r.m) == 15 for r in out) and calls.value == 4
    plan = spark.range(1).select(astrometry.merged(first, F.create_map(F.lit("K3"), F.sha2(F.col("id").cast("string"), 256))).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


@pytest.mark.parametrize("name", ["wcs_header", "solved_header"])
def test_headers_of_a_small_file_are_made_by_all_cores(spark, name):
    from pixelloom import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4


def test_stacks_of_ten_thousand_frames_are_read_once(spark):
    """One shuffle by pixel up to ``MOST_FRAMES`` frames, and the values that ranks by parts give."""
    f = F.col("id")
    px = spark.range(10_000).select(F.lit(0).alias("stack_id"), f.alias("frame_id"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0).alias("c"), F.pmod(f * 7919, F.lit(10_007)).cast("double").alias("v"))
    out = stacking.stack(px, "percentile_clip")
    assert stacking.by_depth(px, None, stacking.MOST_FRAMES)[2] is None
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(y") <= 1
    deep = stacking.stack(px, "percentile_clip", most_frames=2).first().v
    assert out.first().v == pytest.approx(deep)
