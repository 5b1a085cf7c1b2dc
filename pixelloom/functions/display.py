"""Display: transfer curves, automatic stretches, histograms and statistics of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .stats import let, mad_sigmas, quantiles

#: Shadows lie so many deviations below the median, highlights at this quantile.
SHADOW_SIGMAS, HIGHLIGHT = 2.8, 0.999


def _clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def midtone_transfer(x: Column, m: Column) -> Column:
    """((m - 1) x) / ((2m - 1) x - m), within 0 and 1."""
    below = (m * 2 - 1) * x - m
    return _clip((m - 1) * x / F.when(F.abs(below) < 1e-10, -1e-10).otherwise(below), 0.0, 1.0)


def midtone_balance(x: Column, target: Column | float = 0.25) -> Column:
    """The midtone that takes ``x`` to ``target``."""
    t = target if isinstance(target, Column) else F.lit(float(target))
    below = t * x * 2 - t - x
    return F.when((x <= 0) | (x >= 1) | (F.abs(below) < 1e-10), 0.5).otherwise(_clip(F.try_divide(x * (t - 1), below), 0.001, 0.999))


def luminance(px: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y, x, v``: Rec. 601 weights of the three channels; NULL where one is missing."""
    part = lambda c, w: F.sum(F.when(F.col("c") == c, F.col("v") * w))
    return px.groupBy(*keys, "y", "x").agg((part(0, 0.299) + part(1, 0.587) + part(2, 0.114)).alias("v"))


def stretch_params(px: DataFrame, keys: list[str], target: float = 0.25) -> DataFrame:
    """``keys, shadow, high, midtone``: from the valid values of each image; the midtone of one without a range is the
    target, and one without a valid value has the range 0 to 1."""
    px = staged(px.select(*keys, "v"), "to-stretch")  # read for its ends, ranks and deviations
    ranks = staged(quantiles(px, keys, "v", 0.5, HIGHLIGHT).select(*keys, F.col("q0").alias("ranked"), F.col("q1").alias("high")), "ranks")
    sums = px.groupBy(*keys).agg(F.min("v").alias("low")).join(ranks, keys, "left").join(mad_sigmas(px, keys, "v", ranks.drop("high")), keys, "left").withColumnRenamed("ranked", "med")
    shadow = F.greatest(F.col("med") - F.col("sigma") * SHADOW_SIGMAS, F.col("low"))
    out = sums.withColumn("shadow", shadow)
    centre = _clip(F.try_divide(F.col("med") - F.col("shadow"), F.col("high") - F.col("shadow")), 0.001, 0.999)
    midtone = F.when(F.col("high") > F.col("shadow"), midtone_balance(centre, target)).otherwise(F.lit(float(target)))
    return out.select(*keys, F.coalesce("shadow", F.lit(0.0)).alias("shadow"), F.coalesce("high", F.lit(1.0)).alias("high"), midtone.alias("midtone"))


def to_byte(x: Column) -> Column:
    return F.floor(x * 255).cast("int")


def apply_stretch(px: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """``px`` with ``v`` as a byte: missing values and images without a range are 0."""
    width = F.col("high") - F.col("shadow")
    scaled = _clip((F.col("v") - F.col("shadow")) / width, 0.0, 1.0)
    value = F.when((width > 0) & F.col("v").isNotNull(), to_byte(midtone_transfer(scaled, F.col("midtone")))).otherwise(0)
    return px.join(params, keys).withColumn("v", value).select(*px.columns)


def auto_stretch(px: DataFrame, keys: list[str], target: float = 0.25, colour: bool = False) -> DataFrame:
    """Automatic stretch of each image; in colour the parameters come from the luminance and serve all channels."""
    return apply_stretch(px, stretch_params(luminance(px, keys) if colour else px, keys, target), keys)


def linear_stretch(px: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes between the 0.5 % and 99.5 % quantiles."""
    ends = quantiles(px, keys, "v", 0.005, 0.995).select(*keys, F.col("q0").alias("low"), F.col("q1").alias("top"))
    scaled = _clip((F.col("v") - F.col("low")) / (F.col("top") - F.col("low")), 0.0, 1.0)
    value = F.when((F.col("top") > F.col("low")) & F.col("v").isNotNull(), to_byte(scaled)).otherwise(0)
    return px.join(ends, keys, "left").withColumn("v", value).select(*px.columns)


def histogram(px: DataFrame, keys: list[str], bins: int = 256, limits: tuple[float, float] | None = None) -> DataFrame:
    """``keys, bin, n`` of the filled bins, over the range of each image or fixed ``limits``; the last bin is closed."""
    if limits:
        ends = px.select(*keys).distinct().withColumns({"low": F.lit(float(limits[0])), "top": F.lit(float(limits[1]))})
    else:
        ends = px.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("top"))
    rows = px.filter(F.col("v").isNotNull()).join(ends, keys).filter((F.col("top") > F.col("low")) & F.col("v").between(F.col("low"), F.col("top")))
    place = F.floor((F.col("v") - F.col("low")) / (F.col("top") - F.col("low")) * bins)
    return rows.groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shown(histogram: DataFrame) -> DataFrame:
    """A histogram with ``height``, log(1 + n), as it is drawn."""
    return histogram.withColumn("height", F.log1p("n"))


def image_stats(px: DataFrame, keys: list[str]) -> DataFrame:
    sums = px.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("top"), F.avg("v").alias("mean"))
    return sums.join(quantiles(px, keys, "v", 0.5).withColumnRenamed("ranked", "median"), keys, "left")


def moffat_kernel(fwhm: float, beta: float = 3.5, size: int = 0) -> Column:
    """Array of structs ``dy, dx, w``: (1 + r^2 / a^2)^-beta over an odd square, summing to 1."""
    side = size or max(7, int(4 * fwhm) | 1)
    half, a = side // 2, fwhm / (2 * (2 ** (1 / beta) - 1) ** 0.5)
    span = F.sequence(F.lit(-half), F.lit(half))
    at = lambda dy, dx: F.pow(1 + (dy * dy + dx * dx) / (a * a), F.lit(-beta))
    cells = F.flatten(F.transform(span, lambda dy: F.transform(span, lambda dx: F.struct(dy.alias("dy"), dx.alias("dx"), at(dy, dx).alias("w")))))
    return let(cells, lambda k: let(F.aggregate(k, F.lit(0.0), lambda s, e: s + e["w"]), lambda t: F.transform(k, lambda e: F.struct(e["dy"].alias("dy"), e["dx"].alias("dx"), (e["w"] / t).alias("w")))))
