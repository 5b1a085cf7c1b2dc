"""Calibration: master frames, dark scaling by regression, dark and flat correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.stage import staged


def combine(px: DataFrame, method: str = "mean") -> DataFrame:
    """``y, x, c, v``: plain mean or median of frames."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown combination: {method!r}")
    return px.groupBy("y", "x", "c").agg((F.avg if method == "mean" else F.median)("v").alias("v"))


def master_flat(flats: DataFrame, dark_flats: DataFrame | None = None, method: str = "mean") -> DataFrame:
    """Combined flats, less combined dark flats, divided by their global mean; a mean of 0 or less is an error."""
    flat = combine(flats, method)
    if dark_flats is not None:
        dark = combine(dark_flats, method).withColumnRenamed("v", "d")
        flat = flat.join(dark, ["y", "x", "c"], "left").withColumn("v", F.col("v") - F.coalesce("d", F.lit(0.0))).drop("d")
    mean = flat.agg(F.avg("v").alias("mean"))  # one row
    checked = F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.raise_error(F.lit("the mean of the flat is not positive")).cast("double"))
    return flat.crossJoin(F.broadcast(mean)).select("y", "x", "c", (F.col("v") / checked).alias("v"))


def flat_divisor(v: Column, least: float = 0.01) -> Column:
    """What to divide by: 1 where the flat is not above ``least``, or missing."""
    return F.when(v > least, v).otherwise(1.0)


def dark_scale(lights: DataFrame, dark: DataFrame | None, least: int = 1000, share: float = 0.4) -> DataFrame:
    """``frame_id, k`` (and ``stack_id`` where lights have it): slope of light over dark on the sky pixels of each
    frame, within 0.5 and 2.

    Pixels count where both are positive; the sky is what lies at or below the ``share`` quantile.  With fewer than
    ``least`` pixels, or hardly any variance of the dark, the scale is 1.
    """
    on = [k for k in ("stack_id", "frame_id") if k in lights.columns]
    both = lights if dark is None else lights.join(dark.withColumnRenamed("v", "d"), ["y", "x", "c"])
    both = staged(both.filter((F.col("v") > 0) & (F.col("d") > 0)).select(*on, "v", "d"), "light-and-dark")  # read for the quantile and again for the sums
    cut = S.quantiles(both, on, "v", share).withColumnRenamed("ranked", "cut").join(both.groupBy(*on).agg(F.count(F.lit(1)).alias("valid")), on)
    sky = both.join(cut, on).filter(F.col("v") <= F.col("cut")).groupBy(*on)
    fits = sky.agg(F.covar_pop("v", "d").alias("cov"), F.var_pop("d").alias("var"), F.count(F.lit(1)).alias("n"), F.first("valid").alias("valid"))
    slope = F.least(F.greatest(F.try_divide("cov", "var"), F.lit(0.5)), F.lit(2.0))
    usable = (F.col("valid") >= least) & (F.col("n") >= least) & (F.col("var") >= 1e-6)
    found = fits.select(*on, F.when(usable, slope).otherwise(1.0).alias("k"))
    return lights.select(on).distinct().join(found, on, "left").select(*on, F.coalesce("k", F.lit(1.0)).alias("k"))


def _stretched(master: DataFrame, axis: str, side: str, to: str) -> DataFrame:
    """Linear interpolation along an axis from ``side`` to ``to`` places (columns), corners on corners; missing pixels
    are left out and the weights of the rest scaled up."""
    ends = master.select("height", "width", side, to).distinct().withColumn("o", F.explode(F.sequence(F.lit(0), F.col(to) - 1)))
    at = F.when(F.col(to) > 1, F.col("o") * (F.col(side) - 1) / (F.col(to) - 1)).otherwise(0.0)
    ends = ends.withColumn("at", at).withColumn("low", F.least(F.floor("at"), F.greatest(F.col(side) - 2, F.lit(0))).cast("int"))
    taps = F.array(F.struct(F.lit(0).alias("d"), (1 - F.col("at") + F.col("low")).alias("w")), F.struct(F.lit(1).alias("d"), (F.col("at") - F.col("low")).alias("w")))
    taps = ends.select("height", "width", "o", "low", F.inline(taps)).filter("w > 0").select("height", "width", "o", (F.col("low") + F.col("d")).alias(axis), "w")
    keys = [k for k in master.columns if k not in (axis, "v")]
    weight = F.when(F.col("v").isNotNull(), F.col("w"))
    out = master.join(taps, ["height", "width", axis]).groupBy(*keys, F.col("o").cast("int").alias(axis)).agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum(weight)).alias("v"))
    return out.select(master.columns)


def fitted(master: DataFrame, sizes: DataFrame) -> DataFrame:
    """``height, width, y, x, (c,) v``: a master at each size of ``sizes``, as it is where it has that size.

    A master of another size (binned, cropped, or of an earlier session) is resized by linear interpolation with
    corners on corners.  Its own size is that of its columns ``height, width``, or the largest place it has.  The sizes
    and the weights of an axis are small tables; pixels are joined to them by place, one axis at a time.
    """
    own = [F.max(n) if n in master.columns else F.max(k) + 1 for n, k in (("height", "y"), ("width", "x"))]
    ends = master.agg(own[0].alias("from_height"), own[1].alias("from_width"))  # one row
    plain = master.drop("height", "width")
    pairs = sizes.select("height", "width").crossJoin(F.broadcast(ends))
    same = (F.col("height") == F.col("from_height")) & (F.col("width") == F.col("from_width"))
    as_is = plain.crossJoin(F.broadcast(pairs.filter(same))).select("height", "width", *plain.columns)  # at most one size
    other = plain.join(pairs.filter(~same))  # one copy for each other size
    other = _stretched(_stretched(other, "y", "from_height", "height"), "x", "from_width", "width")
    return as_is.unionByName(other.select("height", "width", *plain.columns))


def calibrate(lights: DataFrame, dark: DataFrame | None = None, flat: DataFrame | None = None, least: int = 1000) -> DataFrame:
    """(light - k * dark) / flat by pixel; a master of one channel (without ``c``) serves all channels of the lights.

    Masters of another size than the lights are resized to it (see ``fitted``).  The size of lights is that of their
    columns ``height, width``, which may differ from frame to frame, or the largest place in their stack.
    """
    stack = [k for k in ("stack_id",) if k in lights.columns]
    if "height" in lights.columns and "width" in lights.columns:
        out, sizes = lights, lights.select("height", "width").distinct()
    else:
        ends = staged(lights.groupBy(*stack).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")), "light-sizes")
        out, sizes = lights.join(ends, stack) if stack else lights.crossJoin(F.broadcast(ends)), ends.select("height", "width").distinct()
    place = ["height", "width", "y", "x"]
    if dark is not None:
        master = fitted(dark, sizes).withColumnRenamed("v", "d")
        on = place + (["c"] if "c" in master.columns else [])
        out = out.join(master, on, "left")
        scale = dark_scale(out, None, least)
        out = out.join(scale, scale.columns[:-1]).withColumn("v", F.col("v") - F.col("k") * F.coalesce("d", F.lit(0.0))).drop("d", "k")
    if flat is not None:
        master = fitted(flat, sizes).withColumnRenamed("v", "f")
        on = place + (["c"] if "c" in master.columns else [])
        out = out.join(master, on, "left").withColumn("v", F.col("v") / flat_divisor(F.col("f"))).drop("f")
    return out.select(*lights.columns)
