"""Registration: star triangles matched to a reference, a robust similarity for each frame, a bilinear warp in tiles."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from ..sources.stage import staged
from .neighbours import WHOLE_PIXELS, detect_sources, sources_of, whole_images
from .postprocess import mean_light

FRAME = ["stack_id", "frame_id"]
#: Control points tried one after the other, strict to relaxed, as (sigma, least area, most points).
PROFILES = [(5.0, 5, 50), (3.0, 4, 80), (1.5, 3, 100)]
NEIGHBOURS, TOLERANCE, CLOSE = 5, 0.1, 2.0
#: Pairs of triangles, by likeness, after which an agreement of this share of the fewer sources is taken.
TRIED, AGREED = 2000, 0.25


def triangles(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Invariants (two ratios of side lengths) of triangles among near points, and their corners in canonical order."""
    if len(points) < 3:
        return np.zeros((0, 2)), np.zeros((0, 3), int)
    d = np.sqrt(((points[:, None] - points) ** 2).sum(-1))
    found = {tuple(sorted(t)) for near in d.argsort(1, kind="stable")[:, : NEIGHBOURS + 1] for t in combinations(near.tolist(), 3)}
    shapes, corners = [], []
    for t in sorted(found):
        sides = sorted((d[b, c], a) for a, (b, c) in zip(t, ((t[1], t[2]), (t[0], t[2]), (t[0], t[1]))))
        lengths = [s for s, _ in sides]
        if lengths[0] > 1e-9:
            shapes.append((lengths[2] / lengths[1], lengths[1] / lengths[0]))
            corners.append([a for _, a in sides])
    return np.array(shapes).reshape(-1, 2), np.array(corners, int).reshape(-1, 3)


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least-squares 2 x 3 similarity from source to target points."""
    cs, ct = source.mean(0), target.mean(0)
    s, t = source - cs, target - ct
    below = max((s**2).sum(), 1e-12)
    a, b = (s * t).sum() / below, (s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum() / below
    turn = np.array([[a, -b], [b, a]])
    return np.column_stack([turn, ct - turn @ cs])


def match(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The similarity on which most triangles of two point lists agree; a ValueError where none is found."""
    (si, sc), (ti, tc) = triangles(source), triangles(target)
    pairs = []
    if len(si) and len(ti):
        order = ti[:, 0].argsort(kind="stable")
        low = np.searchsorted(ti[order, 0], si[:, 0] - TOLERANCE)
        high = np.searchsorted(ti[order, 0], si[:, 0] + TOLERANCE)
        for i, (lo, hi) in enumerate(zip(low, high)):
            near = order[lo:hi]
            near = near[np.abs(ti[near, 1] - si[i, 1]) <= TOLERANCE]
            pairs += [(float(np.abs(ti[j] - si[i]).sum()), i, j) for j in near]
    best, most = None, 0
    for k, (_, i, j) in enumerate(sorted(pairs)):
        if k >= TRIED and most >= max(min(4, len(source)), AGREED * min(len(source), len(target))):
            break  # the pairs come by likeness: once some have agreed, later ones do not agree better
        m = similarity(source[sc[i]], target[tc[j]])
        if not 0.5 < np.hypot(m[0, 0], m[1, 0]) < 2:
            continue
        moved = source @ m[:, :2].T + m[:, 2]
        d = np.sqrt(((moved[:, None] - target) ** 2).sum(-1))
        near = d.argmin(1)
        good = d[np.arange(len(source)), near] <= CLOSE
        if good.sum() > most:
            most, best = int(good.sum()), (source[good], target[near[good]])
    if best is None or most < min(4, len(source)):
        raise ValueError("no common pattern of stars")
    return similarity(*best)


def warp(image: np.ndarray, m: np.ndarray, size: tuple[int, int], y: np.ndarray, x: np.ndarray, corner: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Bilinear values for output pixels by the similarity from image to output; NaN outside of an image of ``size``.

    ``image`` is the part of it that starts at ``corner`` (y, x), or several such parts that lie alike (channel, y, x).
    """
    h, w = size
    sx, sy = np.linalg.inv(m[:, :2]) @ (np.stack([x, y]) - m[:, 2:])
    inside = (sx >= -1e-9) & (sy >= -1e-9) & (sx <= w - 1 + 1e-9) & (sy <= h - 1 + 1e-9)
    sx, sy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), w - 2), np.minimum(sy.astype(int), h - 2)
    fx, fy = sx - x0, sy - y0
    out = np.zeros((*image.shape[:-2], len(sx)))
    for j, wy in ((0, 1 - fy), (1, fy)):
        for i, wx in ((0, 1 - fx), (1, fx)):
            weight = wy * wx
            asked = weight > 1e-9  # a place on a pixel asks for that pixel alone
            if not asked.any():
                continue
            py, px = y0 + j - corner[0], x0 + i - corner[1]
            held = (py >= 0) & (px >= 0) & (py < image.shape[-2]) & (px < image.shape[-1])
            value = np.where(held, image[..., np.where(held, py, 0), np.where(held, px, 0)], np.nan)
            out += np.where(asked, weight * value, 0.0)
    return np.where(inside, out, np.nan)


def control_points(mono: DataFrame, size: tuple[int, int]) -> DataFrame:
    """``stack_id, frame_id, lists``: for each profile the places (x, y) of its sources, brightest first."""
    lists = None
    for k, (sigma, area, most) in enumerate(PROFILES):
        found = detect_sources(mono, size, sigma, area, most)
        one = found.groupBy(*FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("k"), "y", "x"))), lambda s: F.array(s["x"].cast("double"), s["y"].cast("double"))).alias(f"p{k}"))
        lists = one if lists is None else lists.join(one, FRAME, "full")
    return lists.select(*FRAME, F.array(*[F.coalesce(f"p{k}", F.array().cast("array<array<double>>")) for k in range(len(PROFILES))]).alias("lists"))


def _whole_points(values: np.ndarray, there: np.ndarray, _: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
    """``control_points`` on arrays of images: a row for each, NULL where no profile has a source."""
    light, lit = mean_light(values, there)
    lists: list[list[list]] = [[[] for _ in PROFILES] for _ in light]
    for k, (sigma, area, most) in enumerate(PROFILES):
        image, y, x, v = sources_of(light, lit, sigma, area, most)
        order = np.lexsort((x, y, -v, image))
        for i, px, py in zip(image[order].tolist(), x[order].tolist(), y[order].tolist()):
            lists[i][k].append([float(px), float(py)])
    kind = pa.list_(pa.list_(pa.list_(pa.float64())))
    return np.arange(len(light)), [pa.array([one if any(one) else None for one in lists], kind)]


def _whole_warper(size: tuple[int, int], reach: int) -> object:
    """Frames of one tile, warped by the ``m`` beside them."""
    oy, ox = (a.ravel() for a in np.mgrid[0 : size[0], 0 : size[1]])

    def warped(values: np.ndarray, there: np.ndarray, channels: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        frames, cs, out = [], [], []
        for k, numbers in enumerate(part.column("m").to_pylist()):
            m = np.array(numbers).reshape(2, 3)
            to_x, to_y = m[:, :2] @ np.stack([ox, oy]) + m[:, 2:]
            on = (to_x > -reach) & (to_y > -reach) & (to_x < size[1] + reach) & (to_y < size[0] + reach)
            met = np.nonzero((there[k].reshape(len(channels), -1) & on).any(1))[0]
            frames += [k] * len(met)
            cs += channels[met].tolist()
            out += list(warp(values[k, met], m, size, oy, ox))
        n = len(oy)
        return np.repeat(np.array(frames, int), n), [np.tile(oy, len(out)), np.tile(ox, len(out)), np.repeat(np.array(cs, int), n), np.concatenate(out) if out else np.zeros(0)]

    return warped


def _align_whole(px: DataFrame, size: tuple[int, int], reference: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """``align_frames`` of frames that are one tile: a frame is gathered for its sources, and once more to be warped."""
    px = px.select(*FRAME, "y", "x", "c", "v")
    lists = StructField("lists", ArrayType(ArrayType(ArrayType(DoubleType()))))
    points = staged(whole_images(px, size, FRAME, _whole_points, [lists]), "points")
    target = points.join(reference_frames(points, reference), FRAME).select("stack_id", F.col("lists").alias("target"))
    found = staged(transforms(points.join(target, "stack_id", "left")), "transforms")
    fields = [StructField("y", IntegerType()), StructField("x", IntegerType()), StructField("c", IntegerType()), StructField("v", DoubleType())]
    out = whole_images(px, size, FRAME, _whole_warper(size, reach), fields, found.filter("m is not null").drop("error"))
    return out.select(*[F.col(k).cast("int").alias(k) for k in FRAME], "y", "x", "c", "v"), found.filter("m is null").select(*FRAME, "error")


def reference_frames(frames: DataFrame, place: int = 0) -> DataFrame:
    """``stack_id, frame_id``: in each stack the frame at a place in the order of ids, the last one where it has fewer."""
    order = Window.partitionBy("stack_id").orderBy("frame_id")
    ranks = frames.select(FRAME).distinct().withColumn("rank", F.row_number().over(order))  # one row a frame
    return ranks.filter(F.col("rank") <= max(0, place) + 1).groupBy("stack_id").agg(F.max("frame_id").alias("frame_id"))


def transforms(points: DataFrame) -> DataFrame:
    """``stack_id, frame_id, m, error``: the similarity (6 numbers, by rows) of each frame with ``lists`` to its stack's
    reference, whose lists are ``target``, or why there is none."""

    @F.pandas_udf("m array<double>, error string")
    def found(lists: pd.Series, targets: pd.Series) -> pd.DataFrame:
        rows = []
        arrays = lambda p: np.array([list(q) for q in p], float).reshape(-1, 2)
        for own_lists, target in zip(lists, targets):
            error, m = "no sources", None
            for own, theirs in zip(own_lists if own_lists is not None else [], target if target is not None else []):
                try:
                    m = match(arrays(own), arrays(theirs)).ravel().tolist()
                    break
                except ValueError as e:
                    error = str(e)
            rows.append((m, None if m else error))
        return pd.DataFrame(rows, columns=["m", "error"])

    return points.select(*FRAME, found("lists", "target").alias("t")).select(*FRAME, "t.m", "t.error")


def _tile_warper(size: tuple[int, int], tile: int) -> object:
    def warped(table: pa.Table) -> pa.Table:
        first = {k: table.column(k)[0].as_py() for k in (*FRAME, "c", "ty", "tx", "m")}
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        corner = int(y.min()), int(x.min())
        image = np.full((y.max() - corner[0] + 1, x.max() - corner[1] + 1), np.nan)
        image[y - corner[0], x - corner[1]] = table.column("v").to_numpy(zero_copy_only=False).astype(float)
        oy, ox = (a.ravel() for a in np.mgrid[first["ty"] * tile : min(size[0], (first["ty"] + 1) * tile), first["tx"] * tile : min(size[1], (first["tx"] + 1) * tile)])
        out = warp(image, np.array(first["m"]).reshape(2, 3), size, oy, ox, corner)
        n = len(oy)
        columns = [np.full(n, first["stack_id"]), np.full(n, first["frame_id"]), oy, ox, np.full(n, first["c"])]
        return pa.table([*[pa.array(a, pa.int32()) for a in columns], pa.array(out, pa.float64(), from_pandas=True)], names=["stack_id", "frame_id", "y", "x", "c", "v"])

    return warped


def align_frames(px: DataFrame, size: tuple[int, int], reference: int = 0, tile: int = 256) -> tuple[DataFrame, DataFrame]:
    """Frames warped onto the reference of their own stack, NULL or without a row outside of their footprint; and an
    error row for each frame that could not be matched.  The reference is the frame at the place ``reference`` in the
    order of the stack's ids (its last one where it has fewer).

    Sources are matched as short lists (at most 100 a profile), one row a frame, to which its stack's reference is joined.
    Pixels are then sent to the output tiles that they may reach, so that a task holds a tile and its surroundings.
    Frames of one tile of up to ``WHOLE_PIXELS`` places stay in their tasks instead.
    """
    reach = 3  # output pixels that a source pixel can bear on, as scales are below 2
    if max(size) <= tile and size[0] * size[1] <= WHOLE_PIXELS:
        return _align_whole(px, size, reference, reach)
    mono = px.groupBy(*FRAME, "y", "x").agg(F.avg("v").alias("v"))
    points = staged(control_points(mono, size), "points")
    frames = staged(mono.select(FRAME).distinct(), "frames")
    target = points.join(reference_frames(frames, reference), FRAME).select("stack_id", F.col("lists").alias("target"))
    found = staged(transforms(frames.join(points, FRAME, "left").join(target, "stack_id", "left")), "transforms")
    plain = px.select(*[F.col(k).cast("int").alias(k) for k in ("stack_id", "frame_id", "y", "x", "c")], "v").join(found.filter("m is not null").drop("error"), FRAME)
    m = F.col("m")
    to_x, to_y = (m[i] * F.col("x") + m[i + 1] * F.col("y") + m[i + 2] for i in (0, 3))
    spread = lambda at, n: F.sequence(F.greatest(F.floor((at - reach) / tile), F.lit(0)), F.least(F.floor((at + reach) / tile), F.lit((n - 1) // tile)))
    on = (to_x > -reach) & (to_y > -reach) & (to_x < size[1] + reach) & (to_y < size[0] + reach)
    sent = plain.filter(on).withColumn("ty", F.explode(spread(to_y, size[0]))).withColumn("tx", F.explode(spread(to_x, size[1])))
    out = sent.withColumns({"ty": F.col("ty").cast("int"), "tx": F.col("tx").cast("int")}).groupBy(*FRAME, "c", "ty", "tx").applyInArrow(_tile_warper(size, tile), "stack_id int, frame_id int, y int, x int, c int, v double")
    return out, found.filter("m is null").select(*FRAME, "error")
