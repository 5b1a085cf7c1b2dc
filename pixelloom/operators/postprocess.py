"""Sharpening, star reduction and non-local means."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from ..functions import stats as S
from ..sources.stage import staged
from .neighbours import IMAGE, WHOLE_PIXELS, both_ways, gaussian_blur, gaussian_taps, local_maxima, middle, peaks_of, smoothed, whole_images

FRAME = ["stack_id", "frame_id"]
#: Amounts of sharpening and filter strengths of denoising by name.
SHARPEN = {"light": 0.12, "medium": 0.22, "strong": 0.38}
DENOISE = {"light": 0.6, "medium": 1.0, "strong": 1.5}
PATCH, SEARCH = 2, 6


def sharpen(px: DataFrame, size: tuple[int, int], fwhm: float = 2.5, strength: str = "medium") -> DataFrame:
    """Unsharp mask: the difference to a blur of the star width, within 0 and 15 % of the value, is added in part."""
    amount = SHARPEN.get(strength, 0.5)
    blur = gaussian_blur(px, size, max(fwhm / 2.3548, 0.5)).withColumnRenamed("v", "b")
    detail = F.least(F.greatest(F.col("v") - F.col("b"), F.lit(0.0)), F.col("v") * 0.15)
    return px.join(blur, [*IMAGE, "y", "x"]).select(*IMAGE, "y", "x", F.when(F.col("v").isNotNull(), F.col("v") + detail * amount).alias("v"))


def reduce_stars(px: DataFrame, size: tuple[int, int], strength: float = 0.5, detect: float = 3.0, mask: float = 3.5, near: float = 25.0, most: int = 50_000, whole: int = WHOLE_PIXELS) -> DataFrame:
    """Stars dimmed towards the background: peaks of a high-pass luminance, a soft mask around them, a blend of a near
    and a far blur as background.  An image without peaks is unchanged.  Images of up to ``whole`` places are gathered
    once; larger ones go by lines and ranks."""
    if strength <= 0:
        return px
    if size[0] * size[1] <= whole:
        fields = [px.schema["c"], StructField("y", IntegerType()), StructField("x", IntegerType()), StructField("v", DoubleType())]
        return whole_images(px, size, FRAME, _whole_reducer(strength, detect, mask, near, most), fields).select(*IMAGE, "y", "x", "v")
    px = staged(px, "to-reduce")
    light = px.groupBy(*FRAME, "y", "x").agg(F.avg("v").alias("v"))
    high = light.join(gaussian_blur(light, size, detect, FRAME).withColumnRenamed("v", "b"), [*FRAME, "y", "x"]).select(*FRAME, "y", "x", (F.col("v") - F.col("b")).alias("v"))
    high = staged(high, "high-pass")  # read for its limits, its peaks and the places of the mask
    spread = S.medians(high.withColumn("v", F.abs("v")), FRAME, "v")
    limits = high.groupBy(*FRAME).agg(F.max("v").alias("top")).join(spread, FRAME, "left").select(*FRAME, F.greatest(F.col("ranked") * S.MAD_SCALE * 2.0, F.col("top") * 0.002).alias("limit"))
    peaks = local_maxima(high.join(limits, FRAME), size, 3, F.col("limit"), most)
    spots = high.select(*FRAME, "y", "x").join(peaks.select(*FRAME, "y", "x", F.lit(1.0).alias("v")), [*FRAME, "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    sigma = detect * mask
    soft = gaussian_blur(spots, size, sigma, FRAME).select(*FRAME, "y", "x", F.greatest(F.least(F.col("v") * (2 * math.pi * sigma * sigma), F.lit(1.0)), F.lit(0.0)).alias("m"))
    blurs = [gaussian_blur(px, size, s).withColumnRenamed("v", n) for s, n in ((near, "near"), (near * 4, "far"))]
    out = px.join(blurs[0], [*IMAGE, "y", "x"]).join(blurs[1], [*IMAGE, "y", "x"]).join(soft, [*FRAME, "y", "x"])
    ground = F.col("near") * (1 - F.col("m")) + F.col("far") * F.col("m")
    dimmed = F.greatest(F.col("v") - strength * F.col("m") * F.greatest(F.col("v") - ground, F.lit(0.0)), F.lit(0.0))
    return out.select(*IMAGE, "y", "x", F.when(F.col("m") > 0, dimmed).otherwise(F.col("v")).alias("v"))


def mean_light(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the channels (image, channel, y, x), NaN where none is valid, and where there is a pixel."""
    valid = np.isfinite(values)
    n = valid.sum(1)
    return np.where(n > 0, np.where(valid, values, 0.0).sum(1) / np.maximum(n, 1), np.nan), there.any(1)


def _whole_reducer(strength: float, detect: float, mask: float, near: float, most: int) -> object:
    """``reduce_stars`` on arrays of images."""
    sigma = detect * mask
    blurs = {s: smoothed(np.array(list(gaussian_taps(s).values()))) for s in (detect, sigma, near, near * 4)}

    def reduce(values: np.ndarray, there: np.ndarray, channels: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        light, lit = mean_light(values, there)
        high = np.where(lit, light - both_ways(blurs[detect], light, lit)[0], np.nan)
        places = high.reshape(len(high), -1)
        top = np.fmax.reduce(places, axis=1)
        limit = np.maximum(middle(np.abs(places)) * S.MAD_SCALE * 2.0, top * 0.002)
        image, y, x = peaks_of(high, lit, 3, limit, most)
        spots = np.where(lit, 0.0, np.nan)
        spots[image, y, x] = 1.0
        m = np.clip(both_ways(blurs[sigma], spots, lit)[0] * (2 * math.pi * sigma * sigma), 0.0, 1.0)[:, None]
        close, far = (both_ways(blurs[s], values, there)[0] for s in (near, near * 4))
        ground = close * (1 - m) + far * m
        dimmed = np.fmax(values - strength * m * np.fmax(values - ground, 0.0), 0.0)
        out = np.where(m > 0, dimmed, values)
        image, c, y, x = np.nonzero(there)
        return image, [channels[c], y, x, out[image, c, y, x]]

    return reduce


def noise_level(px: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """``keys, sigma``: MAD deviation, 0 where nothing is valid."""
    found = S.mad_sigmas(px, keys, "v")
    return px.select(keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def nl_means(image: np.ndarray, h: float, patch: int = PATCH, search: int = SEARCH) -> np.ndarray:
    """Non-local means of one image, edges reflected: box sums of squared differences for each shift."""
    pad = patch + search
    wide = np.pad(image, pad, mode="symmetric")
    rows, columns = image.shape
    total, weights = np.zeros_like(image), np.zeros_like(image)
    side = 2 * patch + 1
    core = wide[search : search + rows + 2 * patch, search : search + columns + 2 * patch]
    sums = np.zeros((rows + side, columns + side))
    inner = sums[1:, 1:]
    for dy in range(-search, search + 1):
        for dx in range(-search, search + 1):
            off = core - wide[search + dy : search + dy + rows + 2 * patch, search + dx : search + dx + columns + 2 * patch]
            off *= off
            np.cumsum(off, 0, out=off)
            np.cumsum(off, 1, out=inner)
            w = sums[side:, side:] - sums[:-side, side:]
            w -= sums[side:, :-side]
            w += sums[:-side, :-side]
            np.maximum(w, 0, out=w)
            w /= -(side * side * h * h)
            np.exp(w, out=w)
            weights += w
            w *= wide[pad + dy : pad + dy + rows, pad + dx : pad + dx + columns]
            total += w
    return total / weights


def _tiles(tile: int) -> object:
    halo = PATCH + SEARCH

    def denoise(table: pa.Table) -> pa.Table:
        first = {k: table.column(k)[0].as_py() for k in (*IMAGE, "ty", "tx", "h", "w", "sigma")}
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        v = table.column("v").to_numpy(zero_copy_only=False).astype(float)
        y0, x0 = y.min(), x.min()
        image = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan)
        image[y - y0, x - x0] = v
        valid = np.isfinite(image)
        image[~valid] = 0.0
        out = nl_means(image, first["h"]) if first["sigma"] >= 1e-10 else image
        own = (y // tile == first["ty"]) & (x // tile == first["tx"])
        y, x = y[own], x[own]
        value = np.where(valid[y - y0, x - x0], out[y - y0, x - x0], np.nan)
        return pa.table({**{k: pa.array([first[k]] * len(y), table.schema.field(k).type) for k in IMAGE}, "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "v": pa.array(value, pa.float64(), from_pandas=True)})

    denoise.halo = halo
    return denoise


def _whole_denoiser(factor: float) -> object:
    """``denoise`` on arrays of images that are one tile."""

    def denoise(values: np.ndarray, there: np.ndarray, _: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        values, there = values[:, 0], there[:, 0]
        places = values.reshape(len(values), -1)
        sigmas = middle(np.abs(places - middle(places)[:, None])) * S.MAD_SCALE
        out = values.copy()
        for k, sigma in enumerate(sigmas):
            if sigma >= 1e-10:
                box = tuple(slice(i.min(), i.max() + 1) for i in np.nonzero(there[k]))
                out[k][box] = nl_means(np.where(np.isfinite(values[k][box]), values[k][box], 0.0), sigma * factor)
        image, y, x = np.nonzero(there)
        return image, [y, x, np.where(np.isfinite(values), out, np.nan)[image, y, x]]

    return denoise


def denoise(px: DataFrame, strength: str = "medium", tile: int = 256, size: tuple[int, int] | None = None) -> DataFrame:
    """Non-local means (5 x 5 patches, 13 x 13 search) of each channel, in tiles with a halo.

    The filter strength is the noise of the whole channel times a factor (1 for an unknown name); an image without noise is unchanged.
    Images known to be of a ``size`` within one tile are gathered once, without their noise being found before.
    """
    if size and max(size) <= tile and size[0] * size[1] <= WHOLE_PIXELS:
        fields = [StructField("y", IntegerType()), StructField("x", IntegerType()), StructField("v", DoubleType())]
        return whole_images(px, size, IMAGE, _whole_denoiser(DENOISE.get(strength, 1.0)), fields)
    px = staged(px, "to-denoise")
    noise = staged(noise_level(px), "noise").withColumns({"h": F.col("sigma") * DENOISE.get(strength, 1.0), "w": F.lit(0)})
    halo = PATCH + SEARCH
    spread = lambda a: F.sequence(F.floor((F.col(a) - halo) / tile), F.floor((F.col(a) + halo) / tile))
    rows = px.join(noise, IMAGE).withColumn("ty", F.explode(spread("y"))).withColumn("tx", F.explode(spread("x")))
    ends = px.groupBy(*IMAGE).agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    rows = rows.join(ends, IMAGE).filter((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * tile <= F.col("my")) & (F.col("tx") * tile <= F.col("mx"))).drop("my", "mx")
    kinds = dict(px.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in IMAGE) + ", y int, x int, v double"
    return rows.groupBy(*IMAGE, "ty", "tx").applyInArrow(_tiles(tile), schema)
