"""Image views over tables: pixels in long form, ``stack_id, frame_id, y, x, c, v`` (v is NULL where invalid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime near the largest price: it brings values to about 0..1 and keeps them off decimal ties.
PRICE_UNIT = 104729
SIDE = 32
SYNTH_SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images: a stack for each label, a frame for each vector."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select(
        F.col("label").alias("stack_id"), F.col("vec_id").alias("frame_id"), (F.col("pos") / 8).cast("int").alias("y"),
        (F.col("pos") % 8).alias("x"), F.lit(0).alias("c"), F.col("value").cast("double").alias("v"),
    )


def line_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as 7 RGB frames of 32 x 32 with natural holes; duplicates of a cell are averaged from integer cents."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") - 1).alias("frame_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x"),
        F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    cells = rows.groupBy("frame_id", "y", "x", "c").agg((F.sum("cents") / (F.count("cents") * 100.0) / PRICE_UNIT).alias("v"))
    return cells.select(F.lit(0).alias("stack_id"), "frame_id", "y", "x", "c", "v")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as frames with a width, a number of stars and an eccentricity."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("frame_id"))
    ecc = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    return rows.agg(F.median("value").alias("fwhm"), F.count("value").alias("n_stars"), ecc.alias("eccentricity")).withColumn("roundness", 1 - F.col("eccentricity"))


def dealt(rows: DataFrame, number: int, most: float, *keys: str) -> DataFrame:
    """``rows``, of which there are ``number``, dealt by ``keys`` over all cores, or more tasks of about ``most`` rows."""
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(number / most) + 1)
    return rows.repartition(tasks, *keys)


#: Frames that are made in one task, about: their pixels fit in its memory, however many frames there are.
TASK_FRAMES = 96


def _supplier_frames(spark: SparkSession, sf_dir: str, stacks: int = 1) -> DataFrame:
    """``stack_id, frame_id``: a frame for each supplier, dealt by frame over all cores or more tasks where there are
    many: a file of few keys is one task, the pixels made of them are many.  What is grouped by frame stays in its task."""
    rows = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("int")
    frames = rows.select((key % stacks).alias("stack_id"), F.floor(key / stacks).cast("int").alias("frame_id")) if stacks > 1 else rows.select(key.alias("frame_id"))
    return dealt(frames, rows.count(), TASK_FRAMES, *frames.columns)


def synth_px(spark: SparkSession, sf_dir: str | None = None, side: int = SYNTH_SIDE, stars: int = 16, frame: int = 0) -> DataFrame:
    """Made-up RGB frames: hashed noise, a gradient and planted stars, in rational arithmetic.  One frame for each
    supplier of ``sf_dir``; without it ``frame`` alone."""
    f, i = F.col("frame_id"), F.col("id")
    frames = _supplier_frames(spark, sf_dir) if sf_dir else spark.range(1).select(F.lit(frame).alias("frame_id"))
    # Places of the stars are found once a frame and kept as doubles: the pixels' own code must stay short to be compiled.
    places = {f"{a}{k}": ((f * p + k * q + r) % side).cast("double") for k in range(stars) for a, p, q, r in (("sy", 3, 41, 11), ("sx", 5, 23, 7))}
    grid = frames.withColumns(places).withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    grid = grid.withColumns({"y": (i / side).cast("int"), "x": i % side})
    total = F.pmod(i.cast("bigint") * 7919 + 104729 + f * 613, F.lit(1009)) / 1009.0 * 0.02 + (F.col("x") * 2 + F.col("y")) / (3.0 * side) * 0.1
    for k in range(stars):
        dx, dy = F.col("x") - F.col(f"sx{k}"), F.col("y") - F.col(f"sy{k}")
        d = dx * dx + dy * dy
        total = total + F.when(d <= 25, (k % 5 + 1) / 10 / (1.0 + d)).otherwise(0.0)
    out = grid.select("frame_id", "y", "x", total.alias("t")).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return out.select(F.lit(0).alias("stack_id"), "frame_id", "y", "x", "c", (F.col("t") * (10 - F.col("c") * 2) / 10.0).alias("v"))


def sky_px(spark: SparkSession, sf_dir: str, side: int = SYNTH_SIDE) -> DataFrame:
    """One RGB frame of tables: order lines give each pixel its noise, nations are stars; hashed noise and a gradient besides."""
    i = F.col("id")
    grid = spark.range(side * side).select("id", (i / side).cast("int").alias("y"), (i % side).cast("int").alias("x"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % side).cast("int").alias("y"), (F.col("l_partkey") % side).cast("int").alias("x"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    noise = lines.groupBy("y", "x").agg((F.sum("cents") / (F.count("cents") * 100.0) / PRICE_UNIT).alias("noise"))
    k, span = F.col("n_nationkey"), F.sequence(F.lit(-5), F.lit(5))
    stars = table(spark, sf_dir, "nation").select(((k * 41 + 11) % side).alias("sy"), ((k * 23 + 7) % side).alias("sx"), ((F.col("n_regionkey") + 1) / 10).alias("a"))
    near = stars.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).withColumn("d", F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).filter(F.col("d") <= 25)
    light = near.groupBy((F.col("sy") + F.col("dy")).alias("y"), (F.col("sx") + F.col("dx")).alias("x")).agg(F.sum(F.col("a") / (1.0 + F.col("d"))).alias("light"))
    seen = grid.join(noise, ["y", "x"], "left").join(light, ["y", "x"], "left")
    total = F.pmod(i * 7919 + 104729, F.lit(1009)) / 1009.0 * 0.02 + F.coalesce("noise", F.lit(0.0)) * 0.02 + (F.col("x") * 2 + F.col("y")) / (3.0 * side) * 0.1 + F.coalesce("light", F.lit(0.0))
    out = seen.select("y", "x", total.alias("t")).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return out.select(F.lit(0).alias("stack_id"), F.lit(0).alias("frame_id"), "y", "x", "c", (F.col("t") * (10 - F.col("c") * 2) / 10.0).alias("v"))


def sky_mosaic(spark: SparkSession, sf_dir: str, pattern: str = "RGGB") -> DataFrame:
    """``sky_px`` as a sensor with a colour filter sees it: one value a pixel."""
    from ..operators.neighbours import site_colour

    return sky_px(spark, sf_dir).filter(F.col("c") == site_colour(F.col("y"), F.col("x"), pattern)).withColumn("c", F.lit(0))


def nation_panels(spark: SparkSession, sf_dir: str, side: int = 24) -> tuple[DataFrame, DataFrame]:
    """``px`` and ``panels``: a panel for each nation, five a row on the sky with some overlap and a little turned, whose
    pixels are the order lines of its suppliers; a pixel without a line is 0."""
    k = F.col("n_nationkey")
    centre = F.array(150 - (k % 5) * 0.02, 20 + F.floor(k / 5) * 0.02)
    turn = (k % 3 - 1) * 0.00002
    panels = table(spark, sf_dir, "nation").select(
        k.alias("panel_id"), F.lit(side).alias("width"), F.lit(side).alias("height"), F.array(F.lit(side / 2), F.lit(side / 2)).alias("crpix"), centre.alias("crval"), F.array(F.lit(-0.001), turn, turn, F.lit(0.001)).alias("cd"))
    of = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("panel_id"))
    lines = table(spark, sf_dir, "lineitem").join(of, "l_suppkey").select("panel_id", (F.col("l_orderkey") % side).cast("int").alias("y"), (F.col("l_partkey") % side).cast("int").alias("x"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    found = lines.groupBy("panel_id", "y", "x").agg((F.sum("cents") / (F.count("cents") * 100.0) / PRICE_UNIT).alias("v"))
    places = panels.select("panel_id", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return places.join(found, ["panel_id", "y", "x"], "left").select("panel_id", "y", "x", F.lit(0).alias("c"), F.coalesce("v", F.lit(0.0)).alias("v")), panels


def synth_shifted(spark: SparkSession, sf_dir: str, side: int = SYNTH_SIDE) -> DataFrame:
    """The first made-up frame as each supplier sees it, up to 3 pixels aside; the first is not shifted."""
    first = synth_px(spark, side=side).drop("frame_id")
    frames = _supplier_frames(spark, sf_dir)
    moved = frames.crossJoin(F.broadcast(first))  # one frame of fixed size times the frames, in the frames' tasks
    f = F.col("frame_id")
    moved = moved.withColumns({"y": F.col("y") + f * 3 % 4, "x": F.col("x") - f * 5 % 4})
    return moved.filter((F.col("y") < side) & (F.col("x") >= 0)).select("stack_id", "frame_id", "y", "x", "c", "v")


def synth_stacks(spark: SparkSession, sf_dir: str, side: int = SYNTH_SIDE) -> DataFrame:
    """Two stacks of different star fields with frame ids of their own, a frame for each supplier, up to 3 pixels aside."""
    fields = synth_px(spark, side=side).unionAll(synth_px(spark, side=side, frame=17))
    fields = fields.select(F.when(F.col("frame_id") == 17, 1).otherwise(0).alias("stack_id"), "y", "x", "c", "v")
    key = F.col("frame_id")
    frames = _supplier_frames(spark, sf_dir, 2)
    moved = frames.join(F.broadcast(fields), "stack_id")  # a field of fixed size to each frame, in the frames' tasks
    moved = moved.withColumns({"y": F.col("y") + key * 3 % 4, "x": F.col("x") - key * 5 % 4})
    return moved.filter((F.col("y") < side) & (F.col("x") >= 0)).select("stack_id", "frame_id", "y", "x", "c", "v")


def synth_mosaic(spark: SparkSession, sf_dir: str | None = None, side: int = SYNTH_SIDE, pattern: str = "RGGB") -> DataFrame:
    """The made-up frames as a sensor with a colour filter sees them: one value a pixel."""
    from ..operators.neighbours import site_colour

    px = synth_px(spark, sf_dir, side)
    return px.filter(F.col("c") == site_colour(F.col("y"), F.col("x"), pattern)).withColumn("c", F.lit(0))
