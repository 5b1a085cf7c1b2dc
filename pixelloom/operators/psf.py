"""Star profiles: cut-outs, elliptical Gaussian fits and moments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import stats as S
from ..sources.stage import staged
from .neighbours import gaussian_blur, local_maxima

FRAME = ["stack_id", "frame_id"]
FWHM = 2.3548
#: Side of the tiles of an image by which stars are gathered.
TILE = 128
#: Fixed limits of an accepted fit.
LEAST_FWHM, MOST_FWHM, LEAST_CONTRAST, MOST_ECCENTRIC, HALF = 0.5, 15.0, 0.1, 0.95, 12
RECORD = "x double, y double, fwhm_x double, fwhm_y double, fwhm double, eccentricity double, roundness double, amplitude double, background double, theta double"


def _model(p: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian and its derivatives by (amplitude, x0, y0, sx, sy, theta, background)."""
    a, x0, y0, sx, sy, t, b = p
    c, s = np.cos(t), np.sin(t)
    u, v = c * (x - x0) + s * (y - y0), -s * (x - x0) + c * (y - y0)
    g = np.exp(-0.5 * (u * u / sx**2 + v * v / sy**2))
    ag = a * g
    d = [g, ag * (c * u / sx**2 - s * v / sy**2), ag * (s * u / sx**2 + c * v / sy**2), ag * u * u / sx**3, ag * v * v / sy**3, -ag * u * v * (1 / sx**2 - 1 / sy**2), np.ones_like(g)]
    return ag + b, np.stack(d, 1)


def fit_gaussian(stamp: np.ndarray, rounds: int = 100) -> tuple[float, ...] | None:
    """Bounded least squares of one star by damped Gauss-Newton steps; None where it is not a star."""
    h, w = stamp.shape
    if min(h, w) < 5:
        return None
    y, x = (a.ravel().astype(float) for a in np.mgrid[:h, :w])
    z = stamp.ravel().astype(float)
    base = float(np.percentile(z, 20))
    if base < 0 or z.max() <= base:
        return None
    p = np.array([z.max() - base, w / 2, h / 2, 2.0, 2.0, 0.0, base])
    low, high = np.array([0, 0, 0, 0.2, 0.2, -np.pi, 0]), np.array([np.inf, w, h, max(w, h), max(w, h), np.pi, np.inf])
    value, slope = _model(p, y, x)
    cost, damp = ((z - value) ** 2).sum(), 1e-3
    for _ in range(rounds):
        normal = slope.T @ slope
        step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), slope.T @ (z - value), rcond=None)[0]
        q = np.clip(p + step, low, high)
        new_value, new_slope = _model(q, y, x)
        new_cost = ((z - new_value) ** 2).sum()
        if new_cost < cost:
            done = cost - new_cost < 1e-12 * max(cost, 1e-30)
            p, value, slope, cost, damp = q, new_value, new_slope, new_cost, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    a, x0, y0, sx, sy, t, b = p
    fx, fy = sorted((abs(sx) * FWHM, abs(sy) * FWHM), reverse=True)
    fwhm, ratio = float(np.sqrt(fx * fy)), fy / max(fx, 1e-12)
    ecc = float(np.sqrt(max(0.0, 1 - ratio**2)))
    if not (LEAST_FWHM <= fwhm <= MOST_FWHM) or a < LEAST_CONTRAST * b or ecc > MOST_ECCENTRIC:
        return None
    return float(x0), float(y0), fx, fy, fwhm, ecc, float(ratio), float(a), float(b), float(t)


def detect_stars(mono: DataFrame, size: tuple[int, int], sigma: float = 3.0, most: int = 60) -> DataFrame:
    """``stack_id, frame_id, y, x``: the brightest peaks of each frame."""
    smooth = gaussian_blur(mono, size, 1.5, FRAME)
    smooth = staged(smooth, "smooth-stars")  # read for its limits and for its peaks
    spread = smooth.groupBy(*FRAME).agg(F.stddev_pop("v").alias("spread")).join(S.medians(smooth, FRAME, "v"), FRAME)
    limits = spread.select(*FRAME, F.greatest(F.col("ranked") + F.col("spread") * sigma, F.col("ranked") + 0.02).alias("limit"))
    return local_maxima(smooth.join(limits, FRAME), size, 8, F.col("limit"), most).select(*FRAME, "y", "x")


def stamps(mono: DataFrame, stars: DataFrame, half: int, use: Callable[[np.ndarray, np.ndarray, int, int], tuple | None], record: str, tile: int = TILE) -> DataFrame:
    """``stack_id, frame_id, y, x`` of each star with the columns of ``record`` that ``use`` gives for its cut-out.

    ``use`` takes the pixels up to ``half`` away that the image has, which of them are there, and the star's place in
    them; stars for which it gives None are left out.  Stars are gathered by tiles of the image, at most as many as a
    tile has pixels, and met by the tile's pixels with a margin of ``half``; tiles without stars are left aside.  So a
    pixel is shuffled about once, not once for each star it is near, and cut-outs are slices in the task.
    """
    at = lambda c, d=0: F.floor((F.col(c) + d) / tile).cast("int")
    lists = stars.select(*FRAME, at("y").alias("ty"), at("x").alias("tx"), F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).alias("s"))
    lists = lists.groupBy(*FRAME, "ty", "tx").agg(F.array_sort(F.collect_list("s")).alias("stars"))
    near = lambda c: F.explode(F.sequence(at(c, -half), at(c, half)))
    rows = mono.select(*FRAME, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"))
    rows = rows.withColumn("ty", near("y")).withColumn("tx", near("x")).join(lists.select(*FRAME, "ty", "tx"), [*FRAME, "ty", "tx"], "left_semi")
    tiles = rows.groupBy(*FRAME, "ty", "tx").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("y", "x", "v")]).join(lists, [*FRAME, "ty", "tx"])
    fields = StructType.fromDDL(record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                y, x, v = (np.asarray(one.column(f"{c}s").flatten()) for c in ("y", "x", "v"))
                y0, x0 = y.min(), x.min()
                image, there = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan), np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
                image[y - y0, x - x0], there[y - y0, x - x0] = v, True
                found = []
                for s in one.column("stars")[0].as_py():
                    low, left = max(s["y"] - half - y0, 0), max(s["x"] - half - x0, 0)
                    cut = np.s_[low : max(0, s["y"] + half + 1 - y0), left : max(0, s["x"] + half + 1 - x0)]
                    if there[cut].any() and (got := use(image[cut], there[cut], int(s["y"] - y0 - low), int(s["x"] - x0 - left))):
                        found.append((s["y"], s["x"], *got))
                rows = pa.array(np.zeros(len(found), np.int64))
                columns = list(zip(*found)) or [()] * (2 + len(fields))
                kinds = [pa.int32()] * 2 + [pa.float64()] * len(fields)
                yield pa.RecordBatch.from_arrays([*[one.column(k).take(rows) for k in FRAME], *[pa.array(list(c), t) for c, t in zip(columns, kinds)]], names=[*FRAME, "y", "x", *fields.names])

    schema = StructType([*[mono.schema[k] for k in FRAME], StructField("y", IntegerType()), StructField("x", IntegerType()), *fields])
    return tiles.select(*FRAME, "ys", "xs", "vs", "stars").mapInArrow(run, schema)


def _fitted(stamp: np.ndarray, there: np.ndarray, y: int, x: int) -> tuple[float, ...] | None:
    """The fit of a star in its cut-out, missing pixels as 0, its place relative to the peak."""
    own = np.flatnonzero(there.any(1)), np.flatnonzero(there.any(0))
    top, left = own[0][0], own[1][0]
    got = fit_gaussian(np.nan_to_num(stamp[top : own[0][-1] + 1, left : own[1][-1] + 1]))
    return got and (got[0] + left - x, got[1] + top - y, *got[2:])


def fit_stars(mono: DataFrame, size: tuple[int, int], sigma: float = 3.0, most: int = 60) -> DataFrame:
    """One accepted fit a row, places in image pixels."""
    names = [f.split()[0] for f in RECORD.split(", ")][2:]
    got = stamps(mono, detect_stars(mono, size, sigma, most), HALF, _fitted, RECORD.replace("x double, y double", "at_x double, at_y double", 1))
    return got.select(*FRAME, (F.col("at_x") + F.col("x")).alias("x"), (F.col("at_y") + F.col("y")).alias("y"), *names)


def frame_psf(mono: DataFrame, size: tuple[int, int], sigma: float = 3.0, most: int = 60) -> DataFrame:
    """``stack_id, frame_id, fwhm, eccentricity, roundness, n_stars``: medians; an infinite width without stars."""
    sums = fit_stars(mono, size, sigma, most).groupBy(*FRAME).agg(*[F.median(n).alias(n) for n in ("fwhm", "eccentricity", "roundness")], F.count(F.lit(1)).cast("int").alias("n_stars"))
    out = mono.select(*FRAME).distinct().join(sums, FRAME, "left")
    return out.select(*FRAME, F.coalesce("fwhm", F.lit(float("inf"))).alias("fwhm"), F.coalesce("eccentricity", F.lit(0.0)).alias("eccentricity"), F.coalesce("roundness", F.lit(1.0)).alias("roundness"), F.coalesce("n_stars", F.lit(0)).alias("n_stars"))


def _moments(stamp: np.ndarray, there: np.ndarray, y: int, x: int) -> tuple[float, ...] | None:
    if not (valid := np.isfinite(stamp)).any():
        return None
    f = np.where(valid, stamp - np.nanmin(stamp), 0.0)
    flux = f.sum()
    if flux <= 0:
        return float(flux), None, None
    dy, dx = (a - p for a, p in zip(np.mgrid[: stamp.shape[0], : stamp.shape[1]], (y, x)))
    xx, yy, xy = ((f * a * b).sum() / flux for a, b in ((dx, dx), (dy, dy), (dx, dy)))
    mean, spread = (xx + yy) / 2, np.hypot((xx - yy) / 2, xy)
    return float(flux), float(np.sqrt(mean + spread) * FWHM), float(np.sqrt(max(mean - spread, 0.0)) * FWHM)


def moment_psf(mono: DataFrame, stars: DataFrame, half: int = 5) -> DataFrame:
    """Widths from flux-weighted second moments about the peak, background (the least value of the cut-out) removed;
    NULL where nothing stands above it."""
    return stamps(mono, stars, half, _moments, "flux double, major double, minor double")
