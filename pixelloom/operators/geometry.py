"""Crops and frame shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop(px: DataFrame, y: int, x: int, height: int, width: int, least: int = 10) -> DataFrame:
    """A half-open window, moved to the origin; a selection below ``least`` pixels a side is ignored."""
    if height < least or width < least:
        return px
    inside = px.filter(F.col("y").between(y, y + height - 1) & F.col("x").between(x, x + width - 1))
    return inside.withColumns({"y": F.col("y") - y, "x": F.col("x") - x})


def auto_crop(px: DataFrame, colour: bool = False, margin: int = 2) -> DataFrame:
    """The bounding box of valid pixels, smaller by ``margin`` on each side, moved to the origin.

    A pixel is valid where it is positive; in colour where no channel is missing and any is positive.  Without a
    valid pixel nothing is cut.
    """
    at = px.groupBy("stack_id", "y", "x").agg(F.max("v").alias("most"), F.count("v").alias("n"), F.count(F.lit(1)).alias("of"))
    good = at.filter((F.col("most") > 0) & (F.col("n") == F.col("of"))) if colour else at.filter(F.col("most") > 0)
    box = good.groupBy("stack_id").agg(*[f(a).alias(f"{a}{n}") for a in "yx" for f, n in ((F.min, 0), (F.max, 1))])
    out = px.join(box, "stack_id", "left")
    low = {a: F.coalesce(F.col(f"{a}0") + margin, F.lit(0)) for a in "yx"}
    inside = F.col("y0").isNull() | (F.col("y").between(F.col("y0") + margin, F.col("y1") - margin) & F.col("x").between(F.col("x0") + margin, F.col("x1") - margin))
    moved = out.filter(inside).withColumns({"_y": F.col("y") - low["y"], "_x": F.col("x") - low["x"]})
    return moved.select(*[F.col(f"_{c}").alias(c) if c in "yx" else F.col(c) for c in px.columns])


def trim_frames(px: DataFrame) -> DataFrame:
    """All frames of a stack cut to the least height and width among them, from the top left."""
    sizes = px.groupBy("stack_id", "frame_id").agg(F.max("y").alias("h"), F.max("x").alias("w")).groupBy("stack_id").agg(F.min("h").alias("h"), F.min("w").alias("w"))
    return px.join(sizes, "stack_id").filter((F.col("y") <= F.col("h")) & (F.col("x") <= F.col("w"))).select(*px.columns)
