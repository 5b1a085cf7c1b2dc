"""Robust statistics as Column expressions over the sorted values of one pixel, and their grouped forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged

#: MAD to standard deviation, as most operators round it and exactly, and the floor of a scale.
MAD_SCALE, MAD_SCALE_EXACT, SCALE_FLOOR = 1.4826, 1.482602218505602, 1e-10


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def median_of(values: Column) -> Column:
    """Median of a sorted array; NULL of an empty one."""

    def middle(a: Column) -> Column:
        n = F.size(a)
        return F.when(n > 0, (F.get(a, ((n - 1) / 2).cast("int")) + F.get(a, (n / 2).cast("int"))) / 2)

    return let(values, middle)


def mean_of(values: Column) -> Column:
    return let(values, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a)))


def mad_of(values: Column, centre: Column) -> Column:
    """Median absolute deviation from ``centre``."""
    return median_of(F.array_sort(F.transform(values, lambda v: F.abs(v - centre))))


def _repeat(values: Column, rounds: int, step: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), values, lambda kept, _: step(kept))


def sigma_clipped(values: Column, low: float = 2.5, high: float = 2.5, rounds: int = 5) -> Column:
    """Sorted ``values`` without those outside of median -low/+high MAD deviations, again and again."""

    def step(kept: Column) -> Column:
        def band(m: Column) -> Column:
            return let(mad_of(kept, m) * MAD_SCALE_EXACT, lambda s: F.filter(kept, lambda v: (v >= m - s * low) & (v <= m + s * high)))

        return let(median_of(kept), band)

    return _repeat(values, rounds, step)


def winsorised(values: Column, low: float = 2.5, high: float = 2.5, rounds: int = 5) -> Column:
    """Sorted ``values`` clamped to median -low/+high MAD deviations, again and again."""

    def step(kept: Column) -> Column:
        def clamp(m: Column) -> Column:
            scale = F.greatest(mad_of(kept, m) * MAD_SCALE, F.lit(SCALE_FLOOR))
            return let(scale, lambda s: F.transform(kept, lambda v: F.greatest(F.least(v, m + s * high), m - s * low)))

        return let(median_of(kept), clamp)

    return _repeat(values, rounds, step)


def trimmed_mean(values: Column, frames: Column, low: float = 10, high: float = 10) -> Column:
    """Mean without the lowest and highest percents of ``frames``; missing values count at the high end.

    Below 3 frames nothing is cut; if the cuts meet, the median is taken.
    """
    cut_low, cut_high = F.floor(frames * low / 100).cast("int"), F.floor(frames * high / 100).cast("int")
    kept = F.slice(values, cut_low + 1, F.greatest(frames.cast("int") - cut_high - cut_low, F.lit(0)))
    return F.when(frames < 3, mean_of(values)).when(cut_low + cut_high >= frames, median_of(values)).otherwise(mean_of(kept))


def sky_level(values: Column, sigma: float = 3.0, rounds: int = 3, least: int = 5, scale: float = MAD_SCALE) -> Column:
    """Median of sorted ``values`` after rounds that drop what exceeds median + ``sigma`` deviations.

    A round that would leave fewer than ``least`` values ends the rounds and does not count.
    """

    def step(state: Column) -> Column:
        kept = state["kept"]
        limit = let(median_of(kept), lambda m: m + mad_of(kept, m) * scale * sigma)
        cut = let(limit, lambda top: F.filter(kept, lambda v: v <= top))
        return let(cut, lambda c: F.when(state["done"] | (F.size(c) < least), F.struct(kept.alias("kept"), F.lit(True).alias("done"))).otherwise(F.struct(c.alias("kept"), F.lit(False).alias("done"))))

    return median_of(_repeat(F.struct(values.alias("kept"), F.lit(False).alias("done")), rounds, step)["kept"])


#: Parts into which the values of a group are dealt to find one of a given rank: a power of two.
PARTS = 32


def weighted_ranks(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """``keys, n, at``: the number of valid values, and an array with the value at each rank that ``ranks`` names (an
    array of them, from 0, by the number of values; NULL beyond it).  Groups without a valid value give no row.

    No group is sorted whole and none is gathered: values are counted first, with partial sums, so that equal ones are
    one row however many there are; then the distinct values are dealt to ``PARTS`` parts by approximate quantiles,
    which are merged before the shuffle, the parts' counts are summed, and only the parts that hold a wanted rank are
    walked by running sums, each by a task of its own.  The result is exact.  The counts are stored.
    """
    valid = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"))
    counted = staged(valid.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("times")), "counted")
    shares = [i / PARTS for i in range(1, PARTS)]
    ends = counted.groupBy(*keys).agg(F.percentile_approx("value", shares, 1000).alias("ends"), F.sum("times").alias("n"))
    dealt = counted.join(ends, keys).withColumn("part", F.lit(0)) if keys else counted.crossJoin(F.broadcast(ends)).withColumn("part", F.lit(0))
    for step in (PARTS >> i for i in range(1, PARTS.bit_length())):  # bisection
        beyond = F.when(F.col("value") > F.get("ends", F.col("part") + step - 1), step).otherwise(0)
        dealt = dealt.withColumn("part", F.col("part") + beyond)
    dealt = dealt.drop("ends")
    counts = dealt.groupBy(*keys, "part").agg(F.sum("times").alias("m"), F.first("n").alias("n"))
    counts = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*keys).orderBy("part")) - F.col("m"))  # at most PARTS rows a group
    asked = counts.select(*keys, "part", "n", "before", "m", F.posexplode(ranks(F.col("n"))).alias("place", "rank"))
    asked = asked.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    wanted = asked.groupBy(*keys, "part", "before").agg(F.collect_list(F.struct("place", "rank")).alias("ranks"))
    inside = dealt.drop("n").join(wanted, [*keys, "part"])
    upto = F.sum("times").over(Window.partitionBy(*keys, "part").orderBy("value")) + F.col("before")
    met = inside.withColumn("upto", upto).withColumn("ranks", F.filter("ranks", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("times"))))
    met = met.filter(F.size("ranks") > 0).select(*keys, F.explode("ranks").alias("r"), "value").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r.place", "value"))).alias("found"))
    most = ends.select(*keys, "n", F.size(ranks(F.col("n"))).alias("size"))
    met = most.join(met, keys, "left") if keys else most.crossJoin(F.broadcast(met))
    return met.select(*keys, "n", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.try_element_at("found", i)).alias("at"))


def ranked(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """``keys, ranked``: the mean of the valid values at some ranks (an array of them, from 0, by the number of values)."""
    found = weighted_ranks(rows, keys, value, lambda n: F.array_distinct(ranks(n)))
    mean = F.aggregate("at", F.lit(0.0), lambda t, v: t + v) / F.size("at")
    return found.select(*keys, mean.alias("ranked"))


def between(n: Column, share: float) -> Column:
    """The two ranks (from 0) that a quantile lies between, as ``percentile`` interpolates."""
    at = (n - 1) * F.lit(float(share))
    return F.array(F.floor(at), F.ceil(at))


def quantiles(rows: DataFrame, keys: list[str], value: str, *shares: float) -> DataFrame:
    """``keys`` and exact quantiles of large groups, linear between ranks: ``ranked`` for one share, else ``q0, q1, ...``."""
    found = weighted_ranks(rows, keys, value, lambda n: F.concat(*[between(n, s) for s in shares]))

    def one(k: int) -> Column:
        at = (F.col("n") - 1) * F.lit(float(shares[k]))
        low, high = F.get("at", F.lit(2 * k)), F.get("at", F.lit(2 * k + 1))
        part = at - F.floor(at)
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    names = ["ranked"] if len(shares) == 1 else [f"q{k}" for k in range(len(shares))]
    return found.select(*keys, *[one(k).alias(name) for k, name in enumerate(names)])


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, ranked``: exact medians of large groups."""
    return ranked(rows, keys, value, lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2)))


def mad_sigmas(rows: DataFrame, keys: list[str], value: str, centres: DataFrame | None = None) -> DataFrame:
    """``keys, sigma``: MAD deviations of large groups, 0 for a constant one, about their medians
    (``centres`` where they are known: ``keys, ranked``)."""
    centres = medians(rows, keys, value) if centres is None else centres
    off = rows.join(centres, keys).select(*keys, F.abs(F.col(value) - F.col("ranked")).alias("off"))
    return medians(off, keys, "off").select(*keys, (F.col("ranked") * MAD_SCALE).alias("sigma"))
