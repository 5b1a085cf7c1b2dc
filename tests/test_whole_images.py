"""Images gathered in one row give what lines, ranks and tiles give; frames that lie together stay where they are."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField
from test_operators import PLACES, pixels, stars_at

from pixelloom import catalog
from pixelloom.operators import neighbours, postprocess, registration

SF, SIZE = "/root/testdata/sf0.001", (64, 60)


@pytest.fixture(scope="module")
def holes(spark):
    """Two frames of three channels with NULLs and pixels that are not there, and one without any value."""
    rng = np.random.default_rng(5)
    sky = stars_at(PLACES, *SIZE)[..., None] * [1.0, 0.8, 0.6]
    a = np.stack([sky + rng.normal(0, 0.01, sky.shape), np.roll(sky, 2, 0) + rng.normal(0, 0.01, sky.shape), np.full_like(sky, np.nan)])
    a[0, 10:13, 20:26] = a[1, :, 7] = np.nan
    px = pixels(spark, a).filter("NOT (frame_id = 0 AND y BETWEEN 40 AND 43 AND x < 9) AND NOT (frame_id = 1 AND c = 2 AND y > 50)")
    return px.localCheckpoint()


def same(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r["v"] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, abs=1e-9))


def stays(name, spark):
    """The plan of a query over frames shuffles no pixel."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"hashpartitioning\([^\n]*\b(y|x|ty|tx)#", plan)
    return plan


def test_sources_of_whole_images(spark, holes):
    mono = holes.filter("c = 0").drop("c")
    for most in (200, 3):
        whole, lines = (neighbours.detect_sources(mono, SIZE, most=most, whole=w) for w in (1 << 16, 0))
        assert whole.count() >= 3
        same(whole, lines, ["stack_id", "frame_id", "y", "x"])
    stays("frames_sources", spark)


def test_frames_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr("pixelloom.sources.views.TASK_FRAMES", 0.25)
    from pixelloom.sources import views

    assert views.synth_px(spark, SF).rdd.getNumPartitions() == 41  # 10 frames, 16 tasks at least


def test_stars_of_whole_images_are_reduced(spark, holes):
    whole, lines = (postprocess.reduce_stars(holes, SIZE, 0.5, whole=w) for w in (1 << 16, 0))
    same(whole, lines, ["stack_id", "frame_id", "y", "x", "c"])
    stays("frames_star_reduce", spark)


def test_whole_frames_are_aligned_as_tiles(spark, holes, monkeypatch):
    key = ["stack_id", "frame_id", "y", "x", "c"]
    good, errors = registration.align_frames(holes, SIZE)
    with monkeypatch.context() as small:
        small.setattr(registration, "WHOLE_PIXELS", 0)
        tiled, failed = registration.align_frames(holes, SIZE)
    same(good, tiled, key)
    assert sorted(errors.collect()) == sorted(failed.collect()) and errors.count() == 1
    stays("align_frames", spark)


def test_stacks_are_aligned_where_their_frames_lie(spark):
    assert "hashpartitioning(stack_id" in stays("align_stacks", spark)
    from pixelloom.sources import views

    plan = views.synth_stacks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1  # the two fields go to the frames, not the frames to two keys


def test_aligned_stacks_store_few_bytes_a_frame(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/supplier.parquet").crossJoin(spark.range(4)).withColumn("s_suppkey", F.col("s_suppkey") + 10 * F.col("id")).drop("id")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    frames, sc = rows.count(), spark.sparkContext
    jvm = sc._gateway.jvm
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), None)
    known = {(s.stageId(), s.attemptId()) for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages())}
    got = catalog.QUERIES["align_stacks"](spark, str(tmp_path)).collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    own = [s for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages()) if (s.stageId(), s.attemptId()) not in known]
    assert len(got) == 3 * frames and sum(r["n"] for r in got) > 3 * frames * 3000
    stored = sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in own)
    assert 0 < stored < 5000 * frames  # a frame has 12,288 pixels


def test_channels_are_warped_at_once():
    rng = np.random.default_rng(8)
    image = rng.random((3, 20, 24))
    y, x = (a.ravel() for a in np.mgrid[0:22, 0:26])
    for m in (np.array([[1.0, 0, 3], [0, 1, -2]]), np.array([[0.9, -0.2, 1.5], [0.2, 0.9, 0.25]])):
        alone = np.stack([registration.warp(c, m, (22, 26), y, x, (1, 2)) for c in image])
        np.testing.assert_array_equal(registration.warp(image, m, (22, 26), y, x, (1, 2)), alone)
        assert np.isfinite(alone).any() and np.isnan(alone).any()


def test_images_are_gathered_by_columns_and_handed_on_in_small_batches(spark):
    px = pixels(spark, np.random.default_rng(9).random((40, 64, 64)))
    rows = neighbours.whole_images(px, (64, 64), ["stack_id", "frame_id"], lambda v, t, c, p: (np.arange(len(v)), [np.full(len(v), v.shape[0])]), [StructField("n", IntegerType())])
    assert max(r["n"] for r in rows.collect()) == neighbours.WHOLE_PIXELS // 64**2
    assert re.search(r"collect_list\(at#\d+L?, 0, 0\)", rows._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("distance", [0, 1, 3, 5, 8])
def test_largest_of_windows(distance):
    rng = np.random.default_rng(distance)
    lines = np.where(rng.random((4, 12)) < 0.3, np.nan, rng.random((4, 12)))
    top, there = neighbours.largest(distance)(lines, np.isfinite(lines))
    for i in range(12):
        near = lines[:, max(0, i - distance) : i + distance + 1]
        held = np.isfinite(near).any(1)
        np.testing.assert_array_equal(there[:, i], held)
        np.testing.assert_array_equal(top[:, i], np.where(held, np.where(np.isfinite(near), near, -np.inf).max(1), np.nan))


def test_medians_of_whole_images(spark, holes):
    whole, plain = neighbours.median_3x3(holes, SIZE), neighbours.median_3x3(holes, SIZE, whole=0)
    same(whole, plain, ["stack_id", "frame_id", "c", "y", "x"])
    assert "Generate explode(array(greatest(" not in stays("frames_median3x3", spark)


def test_whole_images_are_denoised_as_one_tile(spark, holes):
    px = holes.withColumn("v", F.when(F.col("frame_id") == 1, 0.5).otherwise(F.col("v")))  # one without noise
    whole, tiled = postprocess.denoise(px, size=SIZE), postprocess.denoise(px)
    same(whole, tiled, ["stack_id", "frame_id", "c", "y", "x"])
    stays("frames_denoise", spark)
