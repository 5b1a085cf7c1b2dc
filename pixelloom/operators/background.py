"""Background surfaces, gradient removal and colour balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.stage import staged
from .neighbours import IMAGE, resize, window_3x3

FRAME = ["stack_id", "frame_id"]


def cell_sky(px: DataFrame, size: tuple[int, int], grid: int = 6, keys: list[str] = IMAGE) -> DataFrame:
    """``keys, y, x, v``: the sky of each cell of a grid of at least ``grid`` cells a side.

    Positive values, clipped at 3 deviations; with fewer than 5 of them the median of the cell, or 0.  A sky of 0 or
    less, or of a cell without any pixel, is replaced by the median of the image.
    """
    high, wide = max(1, size[0] // grid), max(1, size[1] // grid)
    cells = px.groupBy(*keys, F.floor(F.col("y") / high).cast("int").alias("cy"), F.floor(F.col("x") / wide).cast("int").alias("cx"))
    found = cells.agg(F.array_sort(F.collect_list(F.when(F.col("v") > 0, F.col("v")))).alias("pos"), F.median("v").alias("all"))
    sky = F.when(F.size("pos") < 5, F.coalesce("all", F.lit(0.0))).otherwise(S.sky_level(F.col("pos")))
    rows, columns = grid_size(size, grid)
    middle = S.medians(px, keys, "v").withColumnRenamed("ranked", "whole")
    whole = px.select(*keys).distinct().join(middle, keys, "left").withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    out = whole.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).join(found.withColumn("sky", sky), [*keys, "cy", "cx"], "left")
    return out.select(*keys, F.col("cy").alias("y"), F.col("cx").alias("x"), F.when(F.col("sky") > 0, F.col("sky")).otherwise(F.col("whole")).alias("v"))


def grid_size(size: tuple[int, int], grid: int) -> tuple[int, int]:
    return tuple(-(-n // max(1, n // grid)) for n in size)


def background(px: DataFrame, size: tuple[int, int], grid: int = 6, keys: list[str] = IMAGE) -> DataFrame:
    """The smooth background of each image: cell skies, a 3 x 3 median, cubic splines back to full size."""
    cells = grid_size(size, grid)
    px = staged(px.select(*keys, "y", "x", "v"), "to-grid")  # read for the cells, the medians and the images there are
    smooth = window_3x3(cell_sky(px, size, grid, keys), cells, F.median("v"), keys)
    return resize(smooth, cells, size, 3, keys)


def kth_smallest(rows: DataFrame, keys: list[str], value: str = "v", per: int = 1000) -> DataFrame:
    """``keys, pedestal``: the value at rank n // per (from 0) of the valid ones."""
    return S.ranked(rows, keys, value, lambda n: F.array(F.floor(n / per))).withColumnRenamed("ranked", "pedestal")


def corner(size: tuple[int, int], share: float) -> list[Column]:
    """The four corners as predicates; on tiny images they overlap and count twice."""
    h, w = max(1, int(size[0] * share)), max(1, int(size[1] * share))
    top, low, left, right = F.col("y") < h, F.col("y") >= size[0] - h, F.col("x") < w, F.col("x") >= size[1] - w
    return [top & left, top & right, low & left, low & right]


def corners(px: DataFrame, size: tuple[int, int], share: float = 0.1) -> DataFrame:
    """The pixels of the corners, one row for each corner that holds them."""
    times = sum((c.cast("int") for c in corner(size, share)), F.lit(0))
    return px.withColumn("_times", times).filter(F.col("_times") > 0).withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def remove_gradient(px: DataFrame, size: tuple[int, int], grid: int = 6, colour: bool = False) -> DataFrame:
    """Background subtracted, shifted so that the darkest 0.1 % is 0, clipped at 0.

    In colour one shift serves all channels, and then each channel loses what its corners have over the darkest one's.
    """
    flat = px.join(background(px, size, grid).withColumnRenamed("v", "bg"), [*IMAGE, "y", "x"]).withColumn("v", F.col("v") - F.col("bg")).drop("bg")
    flat = staged(flat, "flat")  # read several times for its ranks
    if not colour:
        return _shifted(flat.join(kth_smallest(flat, IMAGE), IMAGE))
    light = staged(flat.groupBy(*FRAME, "y", "x").agg(F.avg("v").alias("v")), "light")
    shifted = _shifted(flat.join(kth_smallest(light, FRAME), FRAME))
    sky = S.medians(corners(shifted, size).filter(F.col("v") >= 0), IMAGE, "v").withColumnRenamed("ranked", "sky")
    sky = shifted.select(*IMAGE).distinct().join(sky, IMAGE, "left").withColumn("sky", F.coalesce("sky", F.lit(0.0)))
    darkest = sky.groupBy(*FRAME).agg(F.min("sky").alias("least"))
    out = shifted.join(sky.join(darkest, FRAME), IMAGE)
    excess = F.col("sky") - F.col("least")
    value = F.when(F.col("v").isNotNull(), F.greatest(F.col("v") - excess, F.lit(0.0)))
    return out.select(*IMAGE, "y", "x", value.alias("v"))


def clean_corners(px: DataFrame, size: tuple[int, int], share: float = 0.2, grid: int = 8) -> DataFrame:
    """A second pass over what is left of amplifier glow: in each corner (``share`` of a side, two pixels a cell at
    least) a background of ``grid`` cells is subtracted and the rest clipped at 0; the centre is not touched.  Where
    corners overlap, on tiny images, they are taken in turn."""
    h, w = max(grid * 2, int(size[0] * share)), max(grid * 2, int(size[1] * share))
    own = min(h, size[0]), min(w, size[1])
    if own[0] * own[1] < 4 * grid * grid:
        return px
    places = [(y, x) for y in (0, max(0, size[0] - h)) for x in (0, max(0, size[1] - w))]
    apart = 2 * own[0] <= size[0] and 2 * own[1] <= size[1]
    out = px
    for part in [places] if apart else [[p] for p in places]:
        number = F.lit(None).cast("int")
        for k, (y, x) in enumerate(part):
            number = F.when(F.col("y").between(y, y + own[0] - 1) & F.col("x").between(x, x + own[1] - 1), k).otherwise(number)
        marked = staged(out.withColumn("corner", number), "corners")
        top, left = (F.element_at(F.array(*[F.lit(p[i]) for p in part]), F.col("corner") + 1) for i in (0, 1))
        inside = marked.filter(F.col("corner").isNotNull()).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})
        under = background(inside, own, grid, [*IMAGE, "corner"]).withColumnRenamed("v", "bg")
        value = F.when(F.col("v").isNotNull(), F.greatest(F.col("v") - F.col("bg"), F.lit(0.0)))
        cleaned = inside.join(under, [*IMAGE, "corner", "y", "x"]).select(*IMAGE, (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), value.alias("v"))
        out = marked.filter(F.col("corner").isNull()).select(*IMAGE, "y", "x", "v").unionByName(cleaned)
    return out


def _shifted(rows: DataFrame) -> DataFrame:
    value = F.when(F.col("v").isNotNull(), F.greatest(F.col("v") - F.col("pedestal"), F.lit(0.0)))
    return rows.select(*IMAGE, "y", "x", value.alias("v"))


def local_normalise(px: DataFrame, size: tuple[int, int], colour: bool = False) -> DataFrame:
    """Gradient removal of every frame by a grid of 12."""
    return remove_gradient(px, size, 12, colour)


def balance_factors(px: DataFrame, size: tuple[int, int], share: float = 0.1) -> DataFrame:
    """``stack_id, frame_id, c, factor``: what brings the corner sky of each channel to their mean; 1 where it is too dark."""
    vs = F.array_sort(F.collect_list(F.when(F.col("v") >= 0, F.col("v"))))
    sky = corners(px, size, share).groupBy(*IMAGE).agg(vs.alias("vs"))
    sky = sky.select(*IMAGE, F.when(F.size("vs") < 10, 0.0).otherwise(S.sky_level(F.col("vs"), 2.5)).alias("sky"))
    mean = sky.groupBy(*FRAME).agg(F.avg("sky").alias("mean"))
    factor = F.when(F.col("mean") < 1e-8, 1.0).otherwise(F.col("mean") / F.greatest("sky", F.lit(1e-8)))
    return sky.join(mean, FRAME).select(*IMAGE, factor.alias("factor"))


def apply_balance(px: DataFrame, factors: DataFrame) -> DataFrame:
    out = px.join(factors, IMAGE)
    return out.withColumn("v", F.when(F.col("v").isNotNull(), F.greatest(F.col("v") * F.col("factor"), F.lit(0.0)))).drop("factor")


def auto_balance(px: DataFrame, size: tuple[int, int], share: float = 0.1) -> DataFrame:
    return apply_balance(px, balance_factors(px, size, share))


def manual_balance(px: DataFrame, r: float = 1.0, g: float = 1.0, b: float = 1.0) -> DataFrame:
    """Gains of the three channels, clipped at 0."""
    gain = F.element_at(F.array(F.lit(float(r)), F.lit(float(g)), F.lit(float(b))), F.col("c") + 1)
    return px.withColumn("v", F.when(F.col("v").isNotNull(), F.greatest(F.col("v") * gain, F.lit(0.0))))
