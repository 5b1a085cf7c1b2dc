"""Neighbourhoods: filters, resizing and maxima, one axis at a time over the lines of an image.

Spark gathers the pixels of each row or column (as many as the side of the image), and numpy filters a batch of lines
inside the task: pixels are shuffled once for each axis, whatever the width of the filter, and no weight is joined to a
pixel.  3 x 3 windows are plain aggregates over shifted pixels.

Images of up to ``WHOLE_PIXELS`` places are gathered once, one row each, for all steps of an operator: nothing is stored
or shuffled between the steps, and frames that already lie together are not shuffled at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import stats
from ..sources.stage import staged

#: Colours (R 0, G 1, B 2) of the four sites of each filter pattern.
PATTERNS = {"RGGB": (0, 1, 1, 2), "GRBG": (1, 0, 2, 1), "GBRG": (1, 2, 0, 1), "BGGR": (2, 1, 1, 0)}
IMAGE = ["stack_id", "frame_id", "c"]


def reflect(i: int, n: int) -> int:
    """Index of a mirror that repeats the edge, for any distance."""
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def folded(n: int, taps: dict[int, float]) -> dict[tuple[int, int], float]:
    """Weights of a filter on ``n`` places with reflected edges."""
    out: dict[tuple[int, int], float] = {}
    for i in range(n):
        for d, w in taps.items():
            key = (i, reflect(i + d, n))
            out[key] = out.get(key, 0.0) + w
    return out


def gaussian_taps(sigma: float, truncate: float = 4.0) -> dict[int, float]:
    radius = int(truncate * sigma + 0.5)
    w = {d: math.exp(-0.5 * d * d / (sigma * sigma)) for d in range(-radius, radius + 1)}
    total = sum(w.values())
    return {d: x / total for d, x in w.items()}


def linear_weights(n_in: int, n_out: int) -> dict[tuple[int, int], float]:
    """Linear interpolation with corners on corners."""
    out: dict[tuple[int, int], float] = {}
    for i in range(n_out):
        at = i * (n_in - 1) / (n_out - 1) if n_out > 1 else 0.0
        low = min(int(at), max(0, n_in - 2))
        for j, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            if w > 0:
                out[i, j] = out.get((i, j), 0.0) + w
    return out


#: Places on either side beyond which a value does not bear on a spline's coefficient: 0.268 ** 30 is below 1e-17.
SPLINE_REACH = 30


def cubic_weights(n_in: int, n_out: int) -> dict[tuple[int, int], float]:
    """Cubic spline interpolation with corners on corners; the spline mirrors at its ends.

    The coefficients of a spline are the values filtered by sqrt(3) z^|d| with z = sqrt(3) - 2, which dies away within
    ``SPLINE_REACH`` places: a place has some 60 weights, however long the line.
    """
    if n_in == 1:
        return {(i, 0): 1.0 for i in range(n_out)}
    z, period = math.sqrt(3) - 2, 2 * (n_in - 1)
    prefilter = [(d, math.sqrt(3) * z ** abs(d)) for d in range(-SPLINE_REACH, SPLINE_REACH + 1)]
    out: dict[tuple[int, int], float] = {}
    for i in range(n_out):
        at = i * (n_in - 1) / (n_out - 1) if n_out > 1 else 0.0
        low = math.floor(at)
        t = at - low
        four = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
        for j, b in zip(range(low - 1, low + 3), four):
            for d, w in prefilter:
                k = (j + d) % period
                key = i, k if k < n_in else period - k
                out[key] = out.get(key, 0.0) + b * w
    return out


#: Values of a batch of lines, and of a table of weights that is kept as a matrix, at most.
LINE_VALUES, DENSE_WEIGHTS = 1 << 20, 1 << 22


def along_lines(px: DataFrame, axis: str, side: int, to: int, kernel: Callable, keys: list[str], carry: str | None = None) -> DataFrame:
    """``keys, y, x, v``: each line of an image along ``axis`` (``side`` places) through ``kernel``.

    The kernel takes a matrix of lines with NaN for missing values and one that tells where there are pixels, and gives
    ``to`` values a line (NaN for NULL) and where there is a pixel now.  ``carry`` is a struct column that stays with
    its place (NULL where there was no pixel), so that nothing need be joined back; places must not change then.
    """
    other = "x" if axis == "y" else "y"
    gathered = [F.collect_list(F.col(axis).cast("int")).alias("at"), F.collect_list(F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))).alias("vs")]
    carried = [carry] if carry else []
    lines = px.groupBy(*keys, other).agg(*gathered, *[F.collect_list(F.struct(c)).alias("carried") for c in carried])
    named = [*keys, other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, LINE_VALUES // max(side, to))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                line = np.repeat(np.arange(part.num_rows), part.column("at").value_lengths().to_numpy())
                place = part.column("at").flatten().to_numpy()
                values, there = np.full((part.num_rows, side), np.nan), np.zeros((part.num_rows, side), bool)
                values[line, place] = part.column("vs").flatten().to_numpy()
                there[line, place] = True
                out, now = kernel(values, there)
                stays = []
                if carried:
                    held = part.column("carried").flatten()
                    row = np.full((part.num_rows, side), -1)
                    row[line, place] = np.arange(len(held))
                line, place = np.nonzero(now)
                rows = pa.array(line)
                if carried:
                    own = row[line, place]
                    stays = [held.take(pa.array(own, mask=own < 0)).flatten()[0]]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(rows) for k in named], pa.array(place, pa.int32()), pa.array(out[line, place], pa.float64(), from_pandas=True), *stays], names=[*named, axis, "v", *carried]
                )

    schema = StructType([*[px.schema[k] for k in named], StructField(axis, IntegerType()), StructField("v", DoubleType()), *[StructField(c, px.schema[c].dataType) for c in carried]])
    return lines.mapInArrow(run, schema).select(*keys, "y", "x", "v", *carried)


#: Places of an image up to which all its pixels are gathered in one row.
WHOLE_PIXELS = 1 << 16


def whole_images(px: DataFrame, size: tuple[int, int], keys: list[str], kernel: Callable, fields: list[StructField], beside: DataFrame | None = None) -> DataFrame:
    """``keys`` and ``fields``: each image, gathered in one row, through ``kernel``.

    The kernel takes arrays of images (image, channel, y, x) with NaN for missing values, one that tells where there are
    pixels, the numbers of the channels, and the record batch of ``keys`` and of what ``beside`` has for them (images
    without a row there are left out).  It gives the image of each row and the rows' ``fields``.
    """
    place = F.col("y").cast("bigint") * (1 << 20) + F.col("x")
    if "c" in px.columns and "c" not in keys:
        place = F.col("c").cast("bigint") * (1 << 40) + place
    plain = px.select(*keys, place.alias("at"), F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("vs"))  # lists take columns: expressions in them are not compiled
    rows = plain.groupBy(*keys).agg(F.collect_list("at").alias("at"), F.collect_list("vs").alias("vs"))
    rows = rows if beside is None else rows.join(beside, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, WHOLE_PIXELS // (size[0] * size[1]))  # images that stay in a core's cache from step to step
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                image = np.repeat(np.arange(part.num_rows), part.column("at").value_lengths().to_numpy())
                at = part.column("at").flatten().to_numpy()
                channels, c = np.unique(at >> 40, return_inverse=True)
                where = image, c, at >> 20 & (1 << 20) - 1, at & (1 << 20) - 1
                values = np.full((part.num_rows, len(channels), *size), np.nan)
                there = np.zeros(values.shape, bool)
                values[where] = part.column("vs").flatten().to_numpy()
                there[where] = True
                own, columns = kernel(values, there, channels, part)
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, kinds.field(f.name).type, from_pandas=True) for a, f in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(own)) for k in keys], *arrays], names=names)

    schema, names, kinds = StructType([*[px.schema[k] for k in keys], *fields]), [*keys, *[f.name for f in fields]], to_arrow_schema(StructType(fields))
    return rows.mapInArrow(run, schema)


def both_ways(kernel: Callable, images: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A kernel of ``along_lines`` on arrays of images, along y, then along x."""
    for axis in (-2, -1):
        lines, held = images.swapaxes(axis, -1), there.swapaxes(axis, -1)
        out, now = kernel(np.ascontiguousarray(lines).reshape(-1, lines.shape[-1]), np.ascontiguousarray(held).reshape(-1, lines.shape[-1]))
        images, there = out.reshape(lines.shape).swapaxes(axis, -1), now.reshape(lines.shape).swapaxes(axis, -1)
    return images, there


def middle(values: np.ndarray) -> np.ndarray:
    """Medians of the finite values along the last axis, NaN where there are none."""
    ordered = np.sort(values, axis=-1)  # NaN comes last
    n = np.isfinite(ordered).sum(-1, keepdims=True)
    low, high = (np.take_along_axis(ordered, np.maximum(i, 0), -1) for i in ((n - 1) // 2, n // 2))
    return ((low + high) / 2)[..., 0]


def _sums(weights: dict[tuple[int, int], float], side: int, to: int) -> Callable[[np.ndarray], np.ndarray]:
    """Weighted sums of lines: by a matrix, or where that is large by the weights of each place in turn."""
    if side * to <= DENSE_WEIGHTS:
        dense = np.zeros((side, to))
        for (i, j), w in weights.items():
            dense[j, i] = w
        return lambda lines: lines @ dense
    order = sorted(weights)
    out, source, w = np.array([i for i, _ in order]), np.array([j for _, j in order]), np.array([weights[k] for k in order])
    own, starts = np.unique(out, return_index=True)

    def sums(lines: np.ndarray) -> np.ndarray:
        found = np.zeros((len(lines), to))
        step = max(1, 4 * DENSE_WEIGHTS // len(w))
        for lo in range(0, len(lines), step):
            found[lo : lo + step, own] = np.add.reduceat(lines[lo : lo + step, source] * w, starts, axis=1)
        return found

    return sums


def along(px: DataFrame, axis: str, weights: dict[tuple[int, int], float], keys: list[str] = IMAGE, strict: bool = False, carry: str | None = None) -> DataFrame:
    """Weighted sums along ``y`` or ``x``.  Missing pixels are left out and the weights of the rest are scaled up;
    ``strict`` gives NULL there instead."""
    side, to = max(j for _, j in weights) + 1, max(i for i, _ in weights) + 1
    full = sum(w for (i, _), w in weights.items() if i == 0)

    def kernel(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, met = _sums(weights, side, to), _sums(dict.fromkeys(weights, 1.0), side, to)
        valid = np.isfinite(values)
        total, seen = sums(np.where(valid, values, 0.0)), sums(valid.astype(float))
        good = (met(valid.astype(float)) > 0) & (seen != 0)
        if strict:
            good &= np.abs(seen - full) < 1e-9
        scale = 1.0 if strict else full / np.where(good, seen, 1.0)
        return np.where(good, total * scale, np.nan), met(there.astype(float)) > 0

    return along_lines(px, axis, side, to, kernel, keys, carry)


#: Filters of a larger radius go through a Fourier transform, or on lines of up to so many places through a matrix.
DIRECT_RADIUS, MATRIX_SIDE = 24, 256


@lru_cache(maxsize=32)
def _mirrored(taps: bytes, n: int) -> np.ndarray:
    """A filter with reflected edges as a matrix for lines of ``n`` places."""
    weights = np.frombuffer(taps)
    dense = np.zeros((n, n))
    for i in range(n):
        near = (np.arange(len(weights)) - len(weights) // 2 + i) % (2 * n)
        np.add.at(dense[:, i], np.where(near < n, near, 2 * n - 1 - near), weights)
    return dense


def smoothed(taps: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A kernel for ``along_lines``: a symmetric filter with the edges reflected.  No weight is kept for a pair of places:
    lines are padded by their mirror and convolved, tap by tap where the filter is narrow, else by Fourier transforms."""
    radius = len(taps) // 2

    def convolved(lines: np.ndarray) -> np.ndarray:
        if radius > DIRECT_RADIUS and lines.shape[1] <= MATRIX_SIDE:
            return lines @ _mirrored(taps.tobytes(), lines.shape[1])
        wide = np.pad(lines, ((0, 0), (radius, radius)), mode="symmetric")
        n = lines.shape[1]
        if radius <= DIRECT_RADIUS:
            out = taps[radius] * lines
            for d in range(1, radius + 1):
                out += taps[radius + d] * (wide[:, radius - d : radius - d + n] + wide[:, radius + d : radius + d + n])
            return out
        size = 1 << (wide.shape[1] + 2 * radius - 1).bit_length()
        found = np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(taps, size), size)
        return found[:, 2 * radius : 2 * radius + n]

    def met(there: np.ndarray) -> np.ndarray:
        """Whether any place of the window is there."""
        sums = np.pad(np.pad(there, ((0, 0), (radius, radius)), mode="symmetric").astype(np.int64).cumsum(1), ((0, 0), (1, 0)))
        return sums[:, 2 * radius + 1 :] > sums[:, : -2 * radius - 1]

    def kernel(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        valid = np.isfinite(values)
        total = convolved(np.where(valid, values, 0.0))
        if valid.all():
            return total, np.ones_like(valid)
        good, seen = met(valid), convolved(valid.astype(float))
        return np.where(good, total * (taps.sum() / np.where(good, seen, 1.0)), np.nan), met(there)

    return kernel


def largest(distance: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A kernel for ``along_lines``: the largest value within ``distance``."""

    def wide(m: np.ndarray, fill: float | bool) -> np.ndarray:
        top, n = np.pad(m, ((0, 0), (distance, distance)), constant_values=fill), 1
        while n <= 2 * distance:  # of windows of n places those of up to twice as many
            step = min(n, 2 * distance + 1 - n)
            top = np.maximum(top[:, :-step], top[:, step:])
            n += step
        return top

    def kernel(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = wide(np.where(np.isfinite(values), values, -np.inf), -np.inf)
        return np.where(np.isfinite(top), top, np.nan), wide(there, False)

    return kernel


def largest_along(px: DataFrame, axis: str, side: int, distance: int, keys: list[str] = IMAGE, carry: str | None = None) -> DataFrame:
    """The largest value within ``distance`` along ``y`` or ``x``."""
    return along_lines(px, axis, side, side, largest(distance), keys, carry)


def peaks_of(values: np.ndarray, there: np.ndarray, distance: int, limit: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``local_maxima`` of arrays of images (image, y, x) above the image's ``limit``: image, y and x of each peak, the
    largest of an image first."""
    top = both_ways(largest(distance), values, there)[0]
    found = (values == top) & (values > limit[:, None, None])
    inside = np.zeros(values.shape[1:], bool)
    inside[distance : values.shape[1] - distance, distance : values.shape[2] - distance] = True
    image, y, x = np.nonzero(found & inside)
    order = np.lexsort((x, y, -values[image, y, x], image))
    image, y, x = image[order], y[order], x[order]
    if most is not None and len(image):
        rank = np.arange(len(image)) - np.searchsorted(image, image)
        image, y, x = image[rank < most], y[rank < most], x[rank < most]
    return image, y, x


def resize(px: DataFrame, size: tuple[int, int], to: tuple[int, int], order: int = 1, keys: list[str] = IMAGE) -> DataFrame:
    """Linear (1) or cubic spline (3) resize of height and width."""
    make = {1: linear_weights, 3: cubic_weights}[order]
    return along(along(px, "y", make(size[0], to[0]), keys), "x", make(size[1], to[1]), keys)


def gaussian_blur(px: DataFrame, size: tuple[int, int], sigma: float, keys: list[str] = IMAGE, carry: str | None = None) -> DataFrame:
    kernel = smoothed(np.array(list(gaussian_taps(sigma).values())))
    out = along_lines(px, "y", size[0], size[0], kernel, keys, carry)
    return along_lines(out, "x", size[1], size[1], kernel, keys, carry)


def site_colour(y: Column, x: Column, pattern: str) -> Column:
    """Channel of a sensor site."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown filter pattern: {pattern!r}")
    a, b, c, d = PATTERNS[pattern]
    return F.when(y % 2 == 0, F.when(x % 2 == 0, a).otherwise(b)).otherwise(F.when(x % 2 == 0, c).otherwise(d))


def pattern_of_header(header: Column) -> Column:
    """The first valid pattern named by the usual keys of a header map, or NULL."""
    named = [F.upper(F.trim(F.try_element_at(header, F.lit(k)))) for k in ("BAYERPAT", "COLORTYP", "BAYER", "CFA-PATT")]
    return F.coalesce(*[F.when(n.isin(*PATTERNS), n) for n in named])


def _beside(axis: str, n: int) -> Column:
    """The places that take a pixel into their 3-wide window, edges reflected: at an edge its own place counts twice."""
    return F.explode(F.array(F.greatest(F.col(axis) - 1, F.lit(0)), F.col(axis), F.least(F.col(axis) + 1, F.lit(n - 1))))


def debayer(px: DataFrame, size: tuple[int, int], pattern: str = "RGGB") -> DataFrame:
    """RGB from sensor values: the mean of the pixels of each colour in the 3 x 3 window, edges reflected."""
    rows = px.withColumn("c", site_colour(F.col("y"), F.col("x"), pattern)).withColumn("n", F.when(F.col("v").isNotNull(), 1.0))
    for axis, n in zip("yx", size):
        rows = rows.withColumn(axis, _beside(axis, n)).groupBy(*IMAGE, "y", "x").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return rows.select(*IMAGE, "y", "x", F.try_divide("v", "n").alias("v"))


def window_3x3(px: DataFrame, size: tuple[int, int], agg: Column, keys: list[str] = IMAGE) -> DataFrame:
    """An aggregate of ``v`` over the 3 x 3 window, edges reflected."""
    rows = px.withColumn("y", _beside("y", size[0])).withColumn("x", _beside("x", size[1]))
    return rows.groupBy(*keys, "y", "x").agg(agg.alias("v"))


def median_3x3(px: DataFrame, size: tuple[int, int], keys: list[str] = IMAGE, whole: int = WHOLE_PIXELS) -> DataFrame:
    """``keys, y, x, v``: medians of the 3 x 3 window, edges reflected.  Images of more than ``whole`` places go pixel by pixel."""
    if size[0] * size[1] > whole:
        return window_3x3(px, size, F.median("v"), keys)

    def kernel(values: np.ndarray, there: np.ndarray, _: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        near = lambda m: [w[:, dy : dy + size[0], dx : dx + size[1]] for w in [np.pad(m[:, 0], ((0, 0), (1, 1), (1, 1)), mode="edge")] for dy in range(3) for dx in range(3)]
        image, y, x = np.nonzero(np.logical_or.reduce(near(there)))
        return image, [y, x, middle(np.stack(near(values), -1))[image, y, x]]

    return whole_images(px, size, keys, kernel, [StructField("y", IntegerType()), StructField("x", IntegerType()), StructField("v", DoubleType())])


def local_maxima(px: DataFrame, size: tuple[int, int], distance: int, threshold: Column | float, most: int | None = None, order: str = "v", keys: list[str] = ["stack_id", "frame_id"]) -> DataFrame:  # noqa: B006
    """Pixels above ``threshold`` that are the largest of their window, off the border; at most ``most`` for each image.

    Of more, those of the largest ``order`` column are taken, ties by y and x.
    """
    own = [c for c in px.columns if c not in {*keys, "y", "x"}]
    top = px.select(*keys, "y", "x", "v", F.struct(*own).alias("own"))
    for axis, n in zip("yx", size):
        top = largest_along(top, axis, n, distance, keys, "own")
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    inside = F.col("y").between(distance, size[0] - 1 - distance) & F.col("x").between(distance, size[1] - 1 - distance)
    found = top.filter((F.col("own.v") == F.col("v")) & inside).select(*keys, "y", "x", "own.*").filter(F.col("v") > limit).select(*px.columns)
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), "y", "x"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def min_max(px: DataFrame, keys: list[str] = ["stack_id", "frame_id"]) -> DataFrame:  # noqa: B006
    """Values of each image brought to 0..1, missing ones as 0; a constant image keeps its values."""
    filled = px.withColumn("v", F.coalesce("v", F.lit(0.0)))
    ends = filled.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("v"))
    return filled.join(ends, keys).withColumn("v", scaled).drop("lo", "hi")


def brought_to_one(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """``min_max`` on arrays of images (image, y, x)."""
    filled = np.where(there, np.where(np.isfinite(values), values, 0.0), np.nan)
    lo, hi = np.nanmin(filled, axis=(1, 2), keepdims=True), np.nanmax(filled, axis=(1, 2), keepdims=True)
    return np.where(hi > lo, (filled - lo) / np.where(hi > lo, hi - lo, 1.0), filled)


def sources_of(values: np.ndarray, there: np.ndarray, sigma: float, min_area: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``detect_sources`` on arrays of images (image, y, x): image, y, x and v of each source, the brightest of the
    smoothed image first."""
    flat = brought_to_one(values, there)
    smooth, now = both_ways(smoothed(np.array(list(gaussian_taps(max(1.0, min_area / 2)).values()))), flat, there)
    places = smooth.reshape(len(smooth), -1)
    limit = np.maximum(middle(places) + 0.3 * sigma * np.nanstd(places, axis=1), 0.01)
    image, y, x = peaks_of(smooth, now, max(3, min_area), limit, most)
    own = there[image, y, x]
    image, y, x = image[own], y[own], x[own]
    return image, y, x, flat[image, y, x]


def detect_sources(mono: DataFrame, size: tuple[int, int], sigma: float = 3.0, min_area: int = 5, most: int = 200, keys: list[str] = ["stack_id", "frame_id"], whole: int = WHOLE_PIXELS) -> DataFrame:  # noqa: B006
    """``keys, x, y, v``: the brightest peaks of a single-channel image, ``v`` its value before smoothing.

    Blur of half the area, threshold of median + 0.3 ``sigma`` standard deviations (0.01 at least).  Images of up to
    ``whole`` places are gathered once and searched in their task; larger ones go by lines and ranks.
    """
    if size[0] * size[1] <= whole:

        def kernel(values: np.ndarray, there: np.ndarray, _: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
            image, y, x, v = sources_of(values[:, 0], there[:, 0], sigma, min_area, most)
            return image, [x, y, v]

        return whole_images(mono.select(*keys, "y", "x", "v"), size, keys, kernel, [StructField("x", IntegerType()), StructField("y", IntegerType()), StructField("v", DoubleType())])
    flat = min_max(mono, keys).withColumn("sharp", F.struct("v"))
    smooth = staged(gaussian_blur(flat, size, max(1.0, min_area / 2), keys, "sharp"), "smooth")  # read for the limits and for the peaks
    spread = smooth.groupBy(*keys).agg(F.stddev_pop("v").alias("spread"))
    limits = spread.join(stats.medians(smooth, keys, "v"), keys, "left").select(*keys, F.greatest(F.col("ranked") + 0.3 * sigma * F.col("spread"), F.lit(0.01)).alias("limit"))
    peaks = local_maxima(smooth.join(limits, keys), size, max(3, min_area), F.col("limit"), most, keys=keys)
    return peaks.filter(F.col("sharp").isNotNull()).select(*keys, "x", "y", "sharp.v")
