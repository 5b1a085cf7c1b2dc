"""Frame quality: scores, rejection, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _finite(x: str) -> Column:
    return F.col(x).isNotNull() & (F.abs(F.col(x)) < INF) & ~F.isnan(F.col(x).cast("double"))


def _keys(*tables: DataFrame) -> list[str]:
    """What names a frame in all of the tables: ``stack_id`` too where they have it."""
    return [k for k in ("stack_id", "frame_id") if all(k in t.columns for t in tables)]


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on) if on else left.crossJoin(F.broadcast(right))  # one row, of the only stack


def score_frames(frames: DataFrame, sigma: float = 2.0, most_eccentric: float = 0.8) -> DataFrame:
    """``frames`` (``frame_id, fwhm, eccentricity``, and ``stack_id`` where there are several stacks) with ``keep``.

    A frame stays with a finite width at most median + ``sigma`` standard deviations and an eccentricity within its own
    such limit and ``most_eccentric``.  With fewer than 3 finite widths all stay.  The limits are one row a stack.
    """
    on = _keys(frames)[:-1]
    good = F.when(_finite("fwhm"), F.col("fwhm")), F.when(_finite("fwhm"), F.col("eccentricity"))
    limits = frames.groupBy(*on).agg(
        (F.median(good[0]) + sigma * F.stddev_pop(good[0])).alias("wide"), F.least(F.median(good[1]) + sigma * F.stddev_pop(good[1]), F.lit(most_eccentric)).alias("long"), F.count(good[0]).alias("n")
    )
    keep = (F.col("n") < 3) | (_finite("fwhm") & (F.col("fwhm") <= F.col("wide")) & (F.col("eccentricity") <= F.col("long")))
    return _joined(frames, limits, on).withColumn("keep", F.coalesce(keep, F.lit(False))).drop("wide", "long", "n")


def guarded(scores: DataFrame) -> DataFrame:
    """Scores with rejection undone in stacks of fewer than 3 frames or where fewer than 2 would stay."""
    on = _keys(scores)[:-1]
    counts = scores.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"))
    return _joined(scores, counts, on).withColumn("keep", F.col("keep") | (F.col("n") < 3) | (F.col("kept") < 2)).drop("n", "kept")


def accepted(px: DataFrame, scores: DataFrame) -> DataFrame:
    on = _keys(px, scores)
    return px.join(scores.filter("keep").select(on), on, "left_semi")


def rejected(px: DataFrame, scores: DataFrame) -> DataFrame:
    on = _keys(px, scores)
    return px.join(scores.filter("keep").select(on), on, "left_anti")


def frame_counts(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if("keep").alias("accepted"), F.count_if(~F.col("keep")).alias("rejected"), F.count(F.lit(1)).alias("total"))


def psf_weights(scores: DataFrame) -> DataFrame:
    """``frame_id, w`` (and ``stack_id`` where it is known): 1 / width, at least 0.1, times roundness; 0 for a frame
    without stars (infinite width)."""
    return scores.select(*_keys(scores), (F.col("roundness") / F.greatest("fwhm", F.lit(0.1))).alias("w"))


def median_fwhm(scores: DataFrame, scale: int = 1, fallback: float = 2.5) -> DataFrame:
    return scores.agg((F.coalesce(F.median(F.when(_finite("fwhm"), F.col("fwhm"))), F.lit(fallback)) * scale).alias("fwhm"))
