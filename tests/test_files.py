"""Headers patched in place, XISF and PNG files, distortion, wide blurs, ranks with ties, masters of other sizes, stacks."""

import base64
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import stats
from pixelloom.operators import calibration, mosaic, neighbours, psf, registration
from pixelloom.sources import fits, headers, images, png, xisf

from test_operators import image, pixels


def unit(cards, data):
    head = b"".join(c.encode().ljust(80) for c in [*cards, "END"])
    return head.ljust(-(-len(head) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def fits_file(bitpix, values, more=(), tail=b""):
    h, w = values.shape
    cards = ["SIMPLE  =                    T / a standard file", f"BITPIX  = {bitpix:>20} / bits", "NAXIS   =                    2", f"NAXIS1  = {w:>20}", f"NAXIS2  = {h:>20}", "EXTEND  =                    T", *more]
    return unit(cards, values.astype(fits.TYPES[bitpix]).tobytes()) + tail


EXTRA = ["OBJECT  = 'M31     '           / it's the name", "HISTORY made by hand", "COMMENT  and a comment", "", "EXPTIME =                1.5E0 / [s] time", "BLANKVAL=  / nothing"]


def test_header_patch_leaves_the_rest_alone(spark, tmp_path):
    a = np.arange(12).reshape(3, 4)
    second = unit(["XTENSION= 'IMAGE   '", "BITPIX  =                    8", "NAXIS   =                    1", "NAXIS1  =                    5", "PCOUNT  =                    0", "GCOUNT  =                    1", "OBJECT  = 'second'"], b"12345")
    files = {"i16.fits": fits_file(16, a, EXTRA), "f64.fit": fits_file(-64, a / 7, EXTRA), "two.fts": fits_file(32, a, EXTRA * 6, second), "other.fits": fits_file(8, a)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    new = {"OBJECT": "M33 and 'more'", "CRVAL1": "10.5", "BITPIX": "8", "PLTSOLVD": "T", "COUNT": "7", "LONG": "it's " * 30, "A.LONG.KEY": "x"}
    headers.patch_headers(spark.createDataFrame([(n, new) for n in files if n != "other.fits"], "path string, extra map<string,string>"), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith((".", "_"))) == sorted(files)
    for name, old in files.items():
        now = (tmp_path / name).read_bytes()
        if name == "other.fits":
            assert now == old
            continue
        at, was = fits.read_header(now)[1], fits.read_header(old)[1]
        assert now[at:] == old[was:] and len(now) % 2880 == 0  # pixels and further units, byte for byte
        cards, before = headers.cards_of(now[:at]), headers.cards_of(old[:was])
        assert [c for c in cards if c.startswith(("HISTORY", "COMMENT", "BITPIX", "NAXIS", "SIMPLE", "EXPTIME"))] == [c for c in before if c.startswith(("HISTORY", "COMMENT", "BITPIX", "NAXIS", "SIMPLE", "EXPTIME"))]
        assert next(c for c in cards if c.startswith("OBJECT")).rstrip() == "OBJECT  = 'M33 and ''more''' / it's the name"
        header = fits.parse_header(now[:at])
        assert header["CRVAL1"] == 10.5 and header["PLTSOLVD"] is True and header["COUNT"] == 7
        long = [c for c in cards if c.startswith(("LONG", "CONTINUE"))]
        assert "".join(headers.parts_of(c.replace("CONTINUE  ", "X       = ", 1))[1].rstrip("&") if c.startswith("CONT") else headers.parts_of(c)[1].rstrip("&") for c in long).rstrip() == ("it's " * 30).rstrip()
        assert np.array_equal(fits.read_image(now)[1], fits.read_image(old)[1])
    # once more with the same keywords: nothing grows
    again = {n: (tmp_path / n).read_bytes() for n in files}
    headers.patch_headers(spark.createDataFrame([(n, new) for n in files if n != "other.fits"], "path string, extra map<string,string>"), str(tmp_path))
    assert again == {n: (tmp_path / n).read_bytes() for n in files}
    with pytest.raises(Exception, match="written twice"):
        headers.patch_headers(spark.createDataFrame([("i16.fits", new), ("i16.fits", new)], "path string, extra map<string,string>"), str(tmp_path))
    assert again == {n: (tmp_path / n).read_bytes() for n in files}


def test_header_dump(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits_file(16, np.zeros((1, 1)), EXTRA))
    (tmp_path / "b.fits").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[-1]: r for r in headers.read_headers(spark, str(tmp_path)).collect()}
    lines = got["a.fits"].text.split("\n")
    assert lines[0] == f"SIMPLE   = {'True':>30s}  / a standard file" and f"OBJECT   = {repr('M31'):>30s}  / it's the name" in lines and "NAXIS    = 2" in lines
    assert "HISTORY  = 'made by hand'" in lines and "COMMENT  = ' and a comment'" in lines and f"EXPTIME  = {'1.5':>30s}  / [s] time" in lines
    assert got["a.fits"].header["OBJECT"] == "M31" and got["b.fits"].text.startswith("Error reading FITS header") and got["b.fits"].header is None


@pytest.mark.parametrize("codec", ["lz4", "zlib", "zstd", "none"])
def test_xisf_round_trip(spark, tmp_path, codec):
    rng = np.random.default_rng(5)
    mono, rgb = rng.normal(size=(1, 11, 13)).astype(np.float32), rng.normal(size=(1, 9, 7, 3)).astype(np.float32)
    mono[0, 4:8] = np.nan  # more than a stretch
    heads = F.create_map(F.lit("OBJECT"), F.lit("it's <M31>"), F.lit("GAIN"), F.lit("1.5"))
    px = pixels(spark, mono).withColumn("path", F.lit("/x/mono.xisf")).unionAll(pixels(spark, rgb).withColumn("path", F.lit("rgb.xisf"))).withColumn("header", heads)
    xisf.save_images(px.repartition(3), str(tmp_path), codec, stretch=64)
    back = images.load_images(spark, [str(tmp_path / "mono.xisf"), str(tmp_path / "rgb.xisf")])
    for name, a in (("mono", mono), ("rgb", rgb)):
        header, got = xisf.read_image((tmp_path / f"{name}.xisf").read_bytes())
        assert np.array_equal(got.squeeze(), a[0], equal_nan=True) and header["OBJECT"] == "it's <M31>" and header["GAIN"] == "1.5"
        rows = {(r.y, r.x, r.c): r.v for r in back.filter(F.col("path").endswith(f"{name}.xisf")).collect()}
        assert rows == {k[:2] + (k[2] if len(k) > 2 else 0,): None if np.isnan(v) else float(v) for k, v in np.ndenumerate(a[0])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # stretches that begin in one batch and end in another
    try:
        xisf.save_images(px, str(tmp_path / "again"), codec, stretch=64)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (tmp_path / "again/rgb.xisf").read_bytes() == (tmp_path / "rgb.xisf").read_bytes()
    if codec != "none":
        assert (tmp_path / "mono.xisf").stat().st_size < 16_000


def test_xisf_of_others():
    """Integers, normal storage, big-endian, inline and embedded blocks, one compressed and shuffled block."""

    def file(attributes, body="", data=b""):
        xml = f'<?xml version="1.0"?><xisf version="1.0" xmlns="{xisf.NAMESPACE}"><Image {attributes}>{body}<FITSKeyword name="OBJECT" value="\'M31\'" comment=""/></Image></xisf>'.encode()
        return b"XISF0100" + len(xml).to_bytes(4, "little") + bytes(4) + xml.ljust(4080, b"\0") + data

    a = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)  # channels, height, width
    want = np.moveaxis(a, 0, 2)
    base = 'geometry="4:3:2" sampleFormat="UInt16"'
    planes = lambda raw: np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes()
    raw = a.astype("<u2").tobytes()
    packed, lz = zlib.compress(planes(raw)), pa.Codec("lz4_raw").compress(planes(raw)).to_pybytes()
    cases = [
        file(f'{base} location="attachment:4096:48"', data=raw),
        file(f'{base} location="attachment:4096:48" byteOrder="big"', data=a.astype(">u2").tobytes()),
        file(f'{base} location="attachment:4096:48" pixelStorage="Normal"', data=want.astype("<u2").tobytes()),
        file(f'{base} location="attachment:4096:{len(packed)}" compression="zlib+sh:48:2"', data=packed),
        file(f'{base} location="attachment:4096:{len(lz)}" compression="lz4hc+sh:48:2"', data=lz),
        file(f'{base} location="embedded"', f'<Data encoding="base64">{base64.b64encode(raw).decode()}</Data>'),
        file(f'{base} location="embedded"', f'<Data encoding="hex">{raw.hex()}</Data>'),
    ]
    for data in cases:
        header, got = xisf.read_image(data)
        assert np.array_equal(got, want) and header["OBJECT"] == "M31"
    for bad in (b"nothing", file(f'{base} location="url:x"'), file(f'{base} location="attachment:4096:48"'), file('geometry="4:3:2" sampleFormat="Complex32" location="attachment:4096:48"')):
        with pytest.raises(ValueError):
            xisf.read_image(bad)


def unpacked(data):
    """Height x width x channels of an 8-bit PNG without filters, every checksum tested."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        own = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + own) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        head, body = (struct.unpack(">IIBBBBB", own) if kind == b"IHDR" else head), body + (own if kind == b"IDAT" else b"")
        at += 12 + n
    w, h, depth, colour, *_ = head
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)
    assert depth == 8 and not lines[:, 0].any()
    return lines[:, 1:].reshape(h, w, {0: 1, 2: 3}[colour])


def test_png_of_bands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(png, "BAND", 60)
    rng = np.random.default_rng(6)
    grey, rgb = rng.integers(0, 256, (1, 17, 10)), rng.integers(0, 256, (1, 8, 5, 3))
    px = pixels(spark, grey).withColumn("path", F.lit("grey.png")).unionAll(pixels(spark, rgb).withColumn("path", F.lit("a/rgb.png")))
    png.save_pictures(px.filter("not (path = 'grey.png' and y between 6 and 14)").repartition(4), str(tmp_path))
    want = grey[0].copy()
    want[6:15] = 0
    assert np.array_equal(unpacked((tmp_path / "grey.png").read_bytes())[..., 0], want) and np.array_equal(unpacked((tmp_path / "rgb.png").read_bytes()), rgb[0])
    a, b = bytes(range(200)) * 50, b"tail" * 999
    assert png.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    images.export_picture(pixels(spark, rng.normal(size=(1, 6, 7, 3))), str(tmp_path / "out.png"), colour=True)
    assert unpacked((tmp_path / "out.png").read_bytes()).shape == (6, 7, 3)
    with pytest.raises(ValueError, match="unsupported"):
        images.export_picture(px, str(tmp_path / "out.tiff"))


def test_distortion_there_and_back(spark):
    a = [{"p": 2, "q": 0, "k": 2e-6}, {"p": 1, "q": 1, "k": -3e-6}, {"p": 0, "q": 3, "k": 1e-10}]
    b = [{"p": 0, "q": 2, "k": 4e-6}, {"p": 2, "q": 1, "k": 2e-10}]
    y, x = (v.ravel().astype(float) for v in np.mgrid[-900:900:50, -900:900:50])
    u, v = x + mosaic.distortion(a, x, y), y + mosaic.distortion(b, x, y)
    back = mosaic.undistorted(a, b, u, v)
    assert np.abs(back[0] - x).max() < 1e-6 and np.abs(back[1] - y).max() < 1e-6 and np.abs(u - x).max() > 1
    row = [(1, 2000, 2000, [1000.0, 1000.0], [150.0, 20.0], [-0.001, 0.0, 0.0, 0.001], [tuple(t.values()) for t in a], [tuple(t.values()) for t in b])]
    panels = spark.createDataFrame(row, f"panel_id int, width int, height int, crpix array<double>, crval array<double>, cd array<double>, sip_a {mosaic.SIP}, sip_b {mosaic.SIP}")
    sky = mosaic.add_sky(panels.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("x"), F.lit(q).alias("y")) for p, q in ((0.0, 0.0), (500.0, 1700.0), (1999.0, 3.0))])).alias("at")).select("*", "at.x", "at.y"), F.col("x"), F.col("y")).collect()
    grid = {"o_crpix": [1.0, 1.0], "o_cd": [-1e-3, 0.0, 0.0, 1e-3]}
    for r in sky:
        # a grid whose first pixel lies at the sky position looks up the pixel it came from
        place = mosaic.panel_places(r.asDict(recursive=True), grid | {"o_crval": [r.ra, r.dec]}, np.zeros(1), np.zeros(1))
        assert abs(place[0][0] - r.x) < 1e-6 and abs(place[1][0] - r.y) < 1e-6


def test_mosaic_of_tiles_is_one_of_a_single_tile(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 30, 40, [15.0, 20.0], [150.0 - 0.02 * k, 20.0 + 0.01 * k], [-0.001, 0.0001 * k, 0.0001 * k, 0.001]) for k in range(3)]
    panels = spark.createDataFrame(rows, "panel_id int, width int, height int, crpix array<double>, crval array<double>, cd array<double>")
    px = pixels(spark, rng.normal(size=(3, 40, 30))).select(F.col("frame_id").alias("panel_id"), "y", "x", "c", "v").filter("not (panel_id = 1 and y between 3 and 9)")
    grid = mosaic.output_grid(panels)
    key = lambda df: sorted((r.panel_id, r.y, r.x, round(r.v, 9), round(r.w, 9)) for r in df.collect())
    whole = key(mosaic.reproject(px, panels, grid, tile=512))
    assert whole == key(mosaic.reproject(px, panels, grid, tile=16)) and len(whole) > 2500


def test_wide_blur_is_the_plain_sum(spark):
    rng = np.random.default_rng(4)
    for sigma, side in ((2.0, 20), (9.0, 31), (9.0, 500)):
        taps = np.array(list(neighbours.gaussian_taps(sigma).values()))
        values = rng.normal(size=(3, side))
        values[1, ::3] = values[2, 2:] = np.nan
        there = np.ones(values.shape, bool)
        there[2, 5:] = False
        got, now = neighbours.smoothed(taps)(values, there)
        for line in range(3):
            for i in range(0, side, max(1, side // 40)):
                at = [neighbours.reflect(i + d, side) for d in range(-(len(taps) // 2), len(taps) // 2 + 1)]
                valid = np.isfinite(values[line, at])
                want = (taps[valid] * values[line, at][valid]).sum() / taps[valid].sum() * taps.sum() if valid.any() else np.nan
                assert now[line, i] == there[line, at].any() and (np.isnan(got[line, i]) if np.isnan(want) else abs(got[line, i] - want) < 1e-9)
    kernel = neighbours.smoothed(np.array(list(neighbours.gaussian_taps(100.0).values())))
    lines = rng.normal(size=(262, 4000))
    began = time.process_time()
    kernel(lines, np.ones(lines.shape, bool))
    assert time.process_time() - began < 5


def test_ranks_with_ties(spark):
    rng = np.random.default_rng(9)
    groups = {0: [0.0] * 5000 + [1.0] * 3, 1: rng.integers(0, 4, 999).astype(float).tolist(), 2: rng.normal(size=501).tolist(), 3: [7.0], 4: [None, None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double").repartition(4)
    valid = {k: np.array([v for v in vs if v is not None]) for k, vs in groups.items() if k != 4}
    shares = (0.0, 0.005, 0.5, 0.731, 0.999, 1.0)
    got = {r.k: [r[f"q{i}"] for i in range(len(shares))] for r in stats.quantiles(df, ["k"], "v", *shares).collect()}
    assert got.keys() == valid.keys() and all(np.allclose(got[k], np.quantile(valid[k], shares), atol=1e-12) for k in valid)
    assert {r.k: r.ranked for r in stats.medians(df, ["k"], "v").collect()} == pytest.approx({k: float(np.median(v)) for k, v in valid.items()})
    sigmas = {r.k: r.sigma for r in stats.mad_sigmas(df, ["k"], "v").collect()}
    assert sigmas == pytest.approx({k: float(np.median(np.abs(v - np.median(v))) * stats.MAD_SCALE) for k, v in valid.items()})


def test_masters_of_other_sizes(spark):
    rng = np.random.default_rng(2)
    small, lights = rng.uniform(1, 2, (5, 4)), rng.uniform(5, 9, (2, 8, 6, 3))

    def zoomed(a, h, w):
        for axis, n in ((0, h), (1, w)):
            at = np.arange(n) * (a.shape[axis] - 1) / (n - 1)
            a = np.apply_along_axis(lambda line: np.interp(at, np.arange(len(line)), line), axis, a)
        return a

    px = pixels(spark, lights)
    dark = pixels(spark, small[None]).select("y", "x", "v")
    got = calibration.calibrate(px, dark, least=10**6)  # too few pixels for a scale: it is 1
    for c in range(3):
        assert np.allclose(image(got.filter((F.col("c") == c) & (F.col("frame_id") == 1)), 8, 6), lights[1, :, :, c] - zoomed(small, 8, 6))
    flat = pixels(spark, np.stack([small, small * 2, small * 3], -1)[None]).select("y", "x", "c", "v")
    got = calibration.calibrate(px, flat=flat)
    assert np.allclose(image(got.filter("c = 2 and frame_id = 0"), 8, 6), lights[0, :, :, 2] / zoomed(small * 3, 8, 6))
    # frames of sizes of their own, and a master that has one of them already
    mixed = px.filter("frame_id = 0 and y < 5 and x < 4").withColumns({"height": F.lit(5), "width": F.lit(4)}).unionAll(px.filter("frame_id = 1").withColumns({"height": F.lit(8), "width": F.lit(6)}))
    got = calibration.calibrate(mixed, flat=dark)
    assert np.allclose(image(got.filter("frame_id = 0 and c = 0"), 5, 4), lights[0, :5, :4, 0] / small) and np.allclose(image(got.filter("frame_id = 1 and c = 0"), 8, 6), lights[1, :, :, 0] / zoomed(small, 8, 6))


def test_reference_of_each_stack(spark):
    frames = spark.createDataFrame([(0, 3), (0, 5), (0, 9), (1, 7), (1, 7)], "stack_id int, frame_id int")
    assert {tuple(r) for r in registration.reference_frames(frames, 0).collect()} == {(0, 3), (1, 7)}
    assert {tuple(r) for r in registration.reference_frames(frames, 1).collect()} == {(0, 5), (1, 7)}
    assert {tuple(r) for r in registration.reference_frames(frames, 99).collect()} == {(0, 9), (1, 7)}


def test_cut_outs_by_tile(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2, 50, 40))
    px = pixels(spark, a).drop("c").filter("not (frame_id = 1 and y = 20)")
    stars = [(0, f, y, x) for f in (0, 1) for y, x in ((0, 0), (15, 16), (31, 32), (49, 39), (20, 20))]
    seen = {}
    use = lambda cut, there, y, x: (float(np.nansum(np.where(there, cut, 0.0))), float(there.sum()), float(y), float(x))
    got = psf.stamps(px, spark.createDataFrame(stars, "stack_id int, frame_id int, y int, x int"), 3, use, "s double, n double, cy double, cx double", tile=16)
    for r in got.collect():
        box = a[r.frame_id, max(0, r.y - 3) : r.y + 4, max(0, r.x - 3) : r.x + 4].copy()
        rows = np.arange(max(0, r.y - 3), min(50, r.y + 4))
        if r.frame_id == 1:
            box = box[rows != 20]
        assert r.s == pytest.approx(box.sum()) and r.n == box.size and (r.cy, r.cx) == (r.y - max(0, r.y - 3), r.x - max(0, r.x - 3))
        seen[r.frame_id, r.y, r.x] = True
    assert len(seen) == 10
