"""Stacking: reducers over the aligned observations of each pixel.

In stacks of up to ``MOST_FRAMES`` frames the values of a pixel are gathered and sorted once, and every robust reducer is
an expression over that array: one shuffle by pixel, however many rounds it takes.  In deeper stacks no pixel is gathered:
medians and deviations are exact ranks by parts, clipping filters rows, and means are partial sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.stage import staged

PIXEL = ["stack_id", "y", "x", "c"]
#: Frames of a stack up to which the values of a pixel are gathered in one array, of 1 MB then.
MOST_FRAMES = 1 << 17


def with_frames(px: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """``px`` with ``frames``, the number of frames of its stack: by a table ``stack_id, frames`` where it is known
    (one row a stack, so the join is broadcast), else counted over the pixels."""
    if frames is None:
        frames = px.groupBy("stack_id").agg(F.count_distinct("frame_id").alias("frames"))
    return px.join(frames.select("stack_id", "frames"), "stack_id")


def _values(own: Column, frames: Column, prereject: bool, threshold: float) -> Column:
    """Sorted values without those above median + ``threshold`` deviations, where the stack has 3 frames or more."""
    if not prereject:
        return own

    def cut(m: Column) -> Column:
        return S.let(F.greatest(S.mad_of(own, m) * S.MAD_SCALE, F.lit(S.SCALE_FLOOR)), lambda s: F.filter(own, lambda v: v <= m + s * threshold))

    return F.when(frames < 3, own).otherwise(S.let(S.median_of(own), cut))


def pixel_values(px: DataFrame, prereject: bool = True, threshold: float = 10.0, frames: DataFrame | None = None) -> DataFrame:
    """``stack_id, y, x, c, vs, frames``: the sorted valid values of each pixel."""
    rows = with_frames(px, frames).groupBy(*PIXEL).agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("frames").alias("frames"))
    return rows.withColumn("vs", _values(F.col("vs"), F.col("frames"), prereject, threshold))


def _centres(rows: DataFrame, value: str = "v") -> DataFrame:
    """``stack_id, y, x, c, ranked, dev``: median of each pixel and the median distance from it, without gathering a pixel."""
    middle = staged(S.medians(rows, PIXEL, value), "medians")
    off = rows.join(middle, PIXEL).select(*PIXEL, F.abs(F.col(value) - F.col("ranked")).alias("off"))
    return middle.join(staged(S.medians(off, PIXEL, "off").withColumnRenamed("ranked", "dev"), "deviations"), PIXEL)


def _highest(rows: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """``stack_id, y, x, c, most``: up to where a pixel's values count; NULL in stacks of under 3 frames."""
    most = F.col("ranked") + F.greatest(F.col("dev") * S.MAD_SCALE, F.lit(S.SCALE_FLOOR)) * threshold
    return with_frames(_centres(rows), frames).select(*PIXEL, F.when(F.col("frames") >= 3, most).alias("most"))


def by_depth(px: DataFrame, frames: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The number of frames of each stack, and ``px`` of the stacks of up to ``most`` frames and of the deeper ones; None
    for either that has none.  Counts are stored where they are not known, so pixels are read for them once."""
    if frames is None:
        frames = staged(px.groupBy("stack_id").agg(F.count_distinct("frame_id").alias("frames")), "frames")
    ends = frames.agg(F.min("frames").alias("least"), F.max("frames").alias("most")).first()
    if (ends["most"] or 0) <= most:
        return frames, px, None
    if ends["least"] > most:
        return frames, None, px
    deep = frames.filter(F.col("frames") > most).select("stack_id")
    return frames, px.join(deep, "stack_id", "left_anti"), px.join(deep, "stack_id", "left_semi")


def reject_outliers(px: DataFrame, threshold: float = 10.0, frames: DataFrame | None = None, most_frames: int = MOST_FRAMES) -> DataFrame:
    """``px`` with NULL where a value lies above its pixel's median by ``threshold`` deviations."""
    frames, shallow, deep = by_depth(px, frames, most_frames)
    parts = []
    if shallow is not None:
        rows = with_frames(shallow, frames).groupBy(*PIXEL).agg(F.array_sort(F.collect_list("v")).alias("vs"), F.collect_list(F.struct("frame_id", "v")).alias("own"), F.first("frames").alias("frames"))
        most = F.array_max(_values(F.col("vs"), F.col("frames"), True, threshold))
        out = rows.withColumn("most", most).select(*PIXEL, "most", F.inline("own"))
        parts.append(out.select("stack_id", "frame_id", "y", "x", "c", F.when(F.col("v") <= F.col("most"), F.col("v")).alias("v")))
    if deep is not None:
        deep = staged(deep.select("stack_id", "frame_id", "y", "x", "c", "v"), "deep")
        out = deep.join(_highest(deep.filter("v IS NOT NULL"), frames, threshold), PIXEL, "left")
        parts.append(out.select("stack_id", "frame_id", "y", "x", "c", F.when(F.col("most").isNull() | (F.col("v") <= F.col("most")), F.col("v")).alias("v")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def weighted_mean(px: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """Weighted mean over valid values, 0 where their weights sum to 0; ``weights`` has ``on`` and ``w``."""
    rows = px.join(weights, on).filter(F.col("v").isNotNull())
    total = F.sum("w")
    return rows.groupBy(*PIXEL).agg(F.when(total > 0, F.try_divide(F.sum(F.col("w") * F.col("v")), total)).otherwise(0.0).alias("v"))


def frame_noise(px: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, noise``: MAD deviation of the channel mean, floored; 1 where nothing is valid."""
    mono = staged(px.groupBy("stack_id", "frame_id", "y", "x", *[k for k in keys if k not in ("stack_id", "frame_id")]).agg(F.avg("v").alias("m")), "mono")
    found = mono.select(keys).distinct().join(S.mad_sigmas(mono, keys, "m"), keys, "left")
    return found.select(*keys, F.when(F.col("sigma").isNull(), 1.0).otherwise(F.greatest("sigma", F.lit(S.SCALE_FLOOR))).alias("noise"))


def noise_weighted(px: DataFrame, strip_rows: int = 128) -> DataFrame:
    """Weighted mean by 1 / noise squared, the noise taken for each frame and strip of rows."""
    rows = px.withColumn("strip", F.floor(F.col("y") / strip_rows))
    keys = ["stack_id", "frame_id", "strip"]
    weights = frame_noise(rows, keys).select(*keys, (1 / (F.col("noise") * F.col("noise"))).alias("w"))
    return weighted_mean(rows, weights, keys)


#: Reducers over (sorted values, number of frames, parameters).
METHODS: dict[str, Callable[..., Column]] = {
    "mean": lambda vs, n: S.mean_of(vs),
    "median": lambda vs, n: S.median_of(vs),
    "min": lambda vs, n: F.array_min(vs),
    "max": lambda vs, n: F.array_max(vs),
    "sigma_clip": lambda vs, n, low=2.5, high=2.5, rounds=5: S.mean_of(S.sigma_clipped(vs, low, high, rounds)),
    "winsorised": lambda vs, n, low=2.5, high=2.5, rounds=5: S.mean_of(S.winsorised(vs, low, high, rounds)),
    "percentile_clip": lambda vs, n, low=10, high=10: S.trimmed_mean(vs, n, low, high),
}


def _clipped(rows: DataFrame, low: float, high: float, rounds: int, clamp: bool) -> DataFrame:
    """``rows`` without the values beyond median -low/+high deviations of their pixel, again and again; moved to these
    limits instead where ``clamp``.  Rounds end early where no pixel has a value beyond its limits."""
    scale = F.greatest(F.col("dev") * S.MAD_SCALE, F.lit(S.SCALE_FLOOR)) if clamp else F.col("dev") * S.MAD_SCALE_EXACT
    for _ in range(rounds):
        limits = staged(_centres(rows).select(*PIXEL, (F.col("ranked") - scale * low).alias("least"), (F.col("ranked") + scale * high).alias("most")), "limits")
        ends = rows.groupBy(*PIXEL).agg(F.min("v").alias("a"), F.max("v").alias("z"))
        if not ends.join(limits, PIXEL).filter("a < least OR z > most").head(1):
            break
        met = rows.join(limits, PIXEL)
        met = met.withColumn("v", F.greatest(F.least("v", "most"), "least")) if clamp else met.filter("v BETWEEN least AND most")
        rows = staged(met.select(*PIXEL, "v"), "clipped")
    return rows


def _trimmed(rows: DataFrame, frames: DataFrame, low: float, high: float) -> DataFrame:
    """``stack_id, y, x, c, v``: means between two ranks.  Only the values at both ranks are looked for; what lies between
    them is summed, and of the values that equal them as many count as lie within the ranks."""
    counted = with_frames(rows.groupBy(*PIXEL).agg(F.count("v").alias("n"), F.avg("v").alias("mean")), frames)
    cut_low, cut_high = F.floor(F.col("frames") * low / 100), F.floor(F.col("frames") * high / 100)
    end = F.least(F.col("n"), F.greatest(F.col("frames") - cut_high, cut_low))
    counted = staged(counted.withColumns({"start": cut_low, "end": end, "meet": cut_low + cut_high >= F.col("frames")}), "ends")
    # ranks are asked by the number of valid values alone, so rows carry their pixel's two ranks as keys
    keyed = rows.join(counted.filter("frames >= 3 AND NOT meet AND end > start").select(*PIXEL, "start", "end"), PIXEL)
    at = S.weighted_ranks(keyed, [*PIXEL, "start", "end"], "v", lambda n: F.array(F.col("start"), F.col("end") - 1))
    at = staged(at.select(*PIXEL, "start", "end", F.get("at", F.lit(0)).alias("first"), F.get("at", F.lit(1)).alias("last")), "ranks")
    met = rows.join(at, PIXEL).groupBy(*PIXEL).agg(
        F.sum(F.when((F.col("v") > F.col("first")) & (F.col("v") < F.col("last")), F.col("v"))).alias("between"),
        F.count_if(F.col("v") <= F.col("first")).alias("upto"), F.count_if(F.col("v") < F.col("last")).alias("below"),
        *[F.first(k).alias(k) for k in ("start", "end", "first", "last")],
    )
    edges = F.col("first") * (F.col("upto") - F.col("start")) + F.col("last") * (F.col("end") - F.col("below"))
    inner = F.when(F.col("first") == F.col("last"), F.col("first")).otherwise((F.coalesce("between", F.lit(0.0)) + edges) / (F.col("end") - F.col("start")))
    out = counted.join(met.select(*PIXEL, inner.alias("inner")), PIXEL, "left").join(S.medians(rows, PIXEL, "v"), PIXEL, "left")
    return out.select(*PIXEL, F.when(F.col("frames") < 3, F.col("mean")).when(F.col("meet"), F.col("ranked")).otherwise(F.col("inner")).alias("v"))


def _deep(px: DataFrame, method: str, prereject: bool, threshold: float, frames: DataFrame, **params: float) -> DataFrame:
    """``stack`` of stacks of any depth, by ``METHODS``' definitions, without an array of a pixel's values."""
    px = staged(px.select(*PIXEL, "v"), "deep")
    rows = px.filter("v IS NOT NULL")
    if prereject:
        kept = rows.join(_highest(rows, frames, threshold), PIXEL).filter("most IS NULL OR v <= most")
        rows = staged(kept.select(*PIXEL, "v"), "kept")
    if method == "median":
        out = S.medians(rows, PIXEL, "v").withColumnRenamed("ranked", "v")
    elif method == "percentile_clip":
        out = _trimmed(rows, frames, params.get("low", 10), params.get("high", 10))
    else:
        if method in ("sigma_clip", "winsorised"):
            rows = _clipped(rows, params.get("low", 2.5), params.get("high", 2.5), params.get("rounds", 5), method == "winsorised")
        reduce = {"min": F.min, "max": F.max}.get(method, F.avg)
        out = rows.groupBy(*PIXEL).agg(reduce("v").alias("v"))
    return px.select(*PIXEL).distinct().join(out, PIXEL, "left").select(*PIXEL, "v")


def stack(px: DataFrame, method: str = "median", prereject: bool = True, threshold: float = 10.0, frames: DataFrame | None = None, most_frames: int = MOST_FRAMES, **params: float) -> DataFrame:
    """``stack_id, y, x, c, v``: one image for each stack.

    ``frames`` (``stack_id, frames``) saves a scan where the number of frames of each stack is known.
    ``noise_weighted`` takes ``strip_rows``; ``weighted`` takes a ``weights`` DataFrame (``stack_id, frame_id, w``).
    Pixels without a valid value are NULL (0 for the weighted means, where their weights sum to 0).

    Stacks of more than ``most_frames`` frames give the same values another way, in which no task holds a pixel's values:
    a stack that holds a third of all frames is dealt over all tasks.
    """
    if method == "noise_weighted":
        return noise_weighted(reject_outliers(px, threshold, frames, most_frames) if prereject else px, **params)
    if method == "weighted":
        return weighted_mean(reject_outliers(px, threshold, frames, most_frames) if prereject else px, params["weights"], ["stack_id", "frame_id"])
    if method not in METHODS:
        raise ValueError(f"unknown stacking method: {method!r}")
    frames, shallow, deep = by_depth(px, frames, most_frames)
    parts = []
    if shallow is not None:
        rows = pixel_values(shallow, prereject, threshold, frames)
        parts.append(rows.select(*PIXEL, METHODS[method](F.col("vs"), F.col("frames"), **params).alias("v")))
    if deep is not None:
        parts.append(_deep(deep, method, prereject, threshold, frames, **params))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drop_mask(scale: int, fraction: float) -> list[list[bool]]:
    """Which of scale x scale sub-pixels a drop covers: a centred square."""
    drop = max(1, round(scale * fraction))
    margin = (scale - drop) // 2
    inside = [margin <= i < scale - margin for i in range(scale)]
    return [[a and b for b in inside] for a in inside]


def drizzle(px: DataFrame, scale: int = 2, fraction: float = 0.7) -> DataFrame:
    """Mean of valid, non-zero values on a grid ``scale`` times finer; 0 outside of the drops and where nothing is valid."""
    mean = px.groupBy(*PIXEL).agg(F.coalesce(F.avg(F.when(F.col("v") != 0, F.col("v"))), F.lit(0.0)).alias("v"))
    cells = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx"), F.lit(on).alias("on")) for i, row in enumerate(drop_mask(scale, fraction)) for j, on in enumerate(row)])
    fine = mean.select(*PIXEL, "v", F.inline(cells))
    return fine.select("stack_id", (F.col("y") * scale + F.col("dy")).alias("y"), (F.col("x") * scale + F.col("dx")).alias("x"), "c", F.when(F.col("on"), F.col("v")).otherwise(0.0).alias("v"))
