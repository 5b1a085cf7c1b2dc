"""Every query of the engine: the callable and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import astrometry as A
from .functions import display as D
from .operators import background as B
from .operators import calibration as C
from .operators import geometry as G
from .operators import mosaic as M
from .operators import neighbours as N
from .operators import postprocess as P
from .operators import psf, quality, registration, sets, stacking
from .plans import session
from .sources import fits, headers, xisf
from .sources import views as V
from .sources.stage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LINE_SIZE, SYNTH_SIZE = (V.SIDE, V.SIDE), (V.SYNTH_SIDE, V.SYNTH_SIDE)
PIX, IMG = O.PIX, O.IMG


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and never minus zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Stacking.

_AGG = "SELECT stack_id, y, x, c, round({0}, 6) AS v FROM {1} GROUP BY ALL"
for _name, _expr in (("mean", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("median", "median(v)")):
    query(f"stack_{_name}", O.query(O.EMB, O.REJECT, select=_AGG.format(_expr, "pr")))(lambda s, d, m=_name: stacking.stack(V.emb_px(s, d), m))
    query(f"stack_{_name}_rgb", O.query(O.LINE, O.REJECT, select=_AGG.format(_expr, "pr")))(lambda s, d, m=_name: stacking.stack(V.line_px(s, d), m))

_DEV = "(1.4826022185056018 * dev)"
_LAST = f"SELECT stack_id, y, x, c, round(avg(v), 6) AS v FROM (SELECT DISTINCT {PIX} FROM px) LEFT JOIN {{0}} USING ({PIX}) GROUP BY ALL"
_CLIP = O.rounds("pr", f"CASE WHEN v BETWEEN med - 2.5 * {_DEV} AND med + 2.5 * {_DEV} THEN v END", PIX, 5)
query("stack_sigma_clip", O.query(O.LINE, O.REJECT, *_CLIP, select=_LAST.format("r4")))(lambda s, d: stacking.stack(V.line_px(s, d), "sigma_clip"))
_WINSOR = O.rounds("pr", "least(greatest(v, med - 2.5 * greatest(1.4826 * dev, 1e-10)), med + 2.5 * greatest(1.4826 * dev, 1e-10))", PIX, 5)
query("stack_winsorised", O.query(O.LINE, O.REJECT, *_WINSOR, select=_LAST.format("r4")))(lambda s, d: stacking.stack(V.line_px(s, d), "winsorised"))
_TRIM = f"""SELECT stack_id, y, x, c, round(CASE WHEN nf < 3 THEN avg(v) WHEN 2 * (nf * 10 // 100) >= nf THEN median(v)
    ELSE avg(v) FILTER (WHERE r > nf * 10 // 100 AND r <= nf - nf * 10 // 100) END, 6) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY {PIX} ORDER BY v NULLS LAST) AS r FROM pr)
  JOIN (SELECT stack_id, count(DISTINCT frame_id) AS nf FROM px GROUP BY 1) USING (stack_id) GROUP BY {PIX}, nf"""
query("stack_percentile_clip", O.query(O.EMB, O.REJECT, select=_TRIM))(lambda s, d: stacking.stack(V.emb_px(s, d), "percentile_clip"))
query("stack_percentile_clip_rgb", O.query(O.LINE, O.REJECT, select=_TRIM.replace("10 // 100", "20 // 100")))(lambda s, d: stacking.stack(V.line_px(s, d), "percentile_clip", low=20, high=20))
query("stack_two_frames", O.query(O.LINE.replace("FROM lineitem", "FROM lineitem WHERE l_linenumber <= 2"), O.REJECT, select=_TRIM))(
    lambda s, d: stacking.stack(V.line_px(s, d).filter("frame_id < 2"), "percentile_clip")
)
_WEIGHTED = f"""SELECT stack_id, y, x, c, round(coalesce(sum(w * v) / nullif(sum(w), 0), 0), 6) AS v FROM pr JOIN {{0}} WHERE v IS NOT NULL GROUP BY ALL"""


@query("stack_weighted_mean", O.query(O.LINE, O.REJECT, select=_WEIGHTED.format("(SELECT unnest(range(7)) AS frame_id, 1 / (1 + unnest(range(7))) AS w) USING (frame_id)")))
def _weighted(s: SparkSession, d: str) -> DataFrame:
    weights = s.range(7).select(F.lit(0).alias("stack_id"), F.col("id").cast("int").alias("frame_id"), (1 / (1 + F.col("id"))).alias("w"))
    return stacking.stack(V.line_px(s, d), "weighted", weights=weights)


_NOISE = """(SELECT frame_id, strip, 1 / pow(greatest(1.4826 * mad(m), 1e-10), 2) AS w FROM (
    SELECT frame_id, y // 8 AS strip, y, x, avg(v) AS m FROM pr GROUP BY ALL) GROUP BY ALL) n ON n.frame_id = pr.frame_id AND n.strip = pr.y // 8"""
query("stack_noise_weighted", O.query(O.LINE, O.REJECT, select=_WEIGHTED.format(_NOISE)))(lambda s, d: stacking.stack(V.line_px(s, d), "noise_weighted", strip_rows=8))
query("prereject_counts", O.query(O.LINE, O.REJECT, select="SELECT frame_id, count(*) AS n, count(v) AS kept FROM pr GROUP BY 1"))(
    lambda s, d: stacking.reject_outliers(V.line_px(s, d)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("kept"))
)
for _scale, _low, _high in ((2, 0, 2), (6, 1, 5)):
    _sql = f"""SELECT stack_id, (y * {_scale} + dy)::INT AS y, (x * {_scale} + dx)::INT AS x, c,
      round(CASE WHEN dy >= {_low} AND dy < {_high} AND dx >= {_low} AND dx < {_high} THEN m ELSE 0 END, 6) AS v
      FROM (SELECT stack_id, y, x, c, coalesce(avg(v) FILTER (WHERE v <> 0), 0) AS m FROM px GROUP BY ALL), range({_scale}) a(dy), range({_scale}) b(dx)"""
    query(f"drizzle_x{_scale}", O.query(O.LINE, select=_sql))(lambda s, d, k=_scale: stacking.drizzle(V.line_px(s, d), k))

# Calibration: frames 0-2 are darks, 3-4 flats, 5-6 lights.

_MASTERS = """dark AS MATERIALIZED (SELECT y, x, c, median(v) AS d FROM px WHERE frame_id < 3 GROUP BY ALL),
flat AS MATERIALIZED (SELECT y, x, c, f / avg(f) OVER () AS f FROM (SELECT y, x, c, avg(v) AS f FROM px WHERE frame_id IN (3, 4) GROUP BY ALL)),
pair AS MATERIALIZED (SELECT frame_id, v, d FROM px JOIN dark USING (y, x, c) WHERE frame_id > 4 AND v > 0 AND d > 0),
fit AS MATERIALIZED (
  SELECT frame_id, CASE WHEN any_value(n) >= 100 AND count(*) >= 100 AND var_pop(d) >= 1e-6 THEN least(greatest(regr_slope(v, d), 0.5), 2) ELSE 1 END AS k
  FROM pair JOIN (SELECT frame_id, quantile_cont(v, 0.4) AS cut, count(*) AS n FROM pair GROUP BY 1) USING (frame_id) WHERE v <= cut GROUP BY 1),
scale AS (SELECT frame_id, coalesce(k, 1)::DOUBLE AS k FROM (SELECT DISTINCT frame_id FROM px WHERE frame_id > 4) LEFT JOIN fit USING (frame_id))"""


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    px = V.line_px(s, d)
    return px.filter("frame_id > 4"), C.combine(px.filter("frame_id < 3"), "median"), C.master_flat(px.filter("frame_id in (3, 4)"))


query("master_dark_median", O.query(O.LINE, _MASTERS, select="SELECT y, x, c, round(d, 6) AS v FROM dark"))(lambda s, d: _parts(s, d)[1])
query("master_flat", O.query(O.LINE, _MASTERS, select="SELECT y, x, c, round(f, 6) AS v FROM flat"))(lambda s, d: _parts(s, d)[2])
query("flat_divisor", O.query(O.LINE, _MASTERS, select="SELECT y, x, c, round(CASE WHEN f > 0.5 THEN f ELSE 1 END, 6) AS v FROM flat"))(
    lambda s, d: _parts(s, d)[2].withColumn("v", C.flat_divisor(F.col("v"), 0.5))
)
query("dark_scale", O.query(O.LINE, _MASTERS, select="SELECT frame_id, round(k, 6) AS k FROM scale"))(lambda s, d: C.dark_scale(*_parts(s, d)[:2], least=100).drop("stack_id"))
query("calibrate_light", O.query(O.LINE, _MASTERS, select="""SELECT stack_id, frame_id, y, x, c, round((v - k * coalesce(d, 0)) / CASE WHEN f > 0.01 THEN f ELSE 1 END, 6) AS v
  FROM px JOIN scale USING (frame_id) LEFT JOIN dark USING (y, x, c) LEFT JOIN flat USING (y, x, c)"""))(lambda s, d: C.calibrate(*_parts(s, d), least=100))  # fmt: skip

# A mono dark of 24 x 24 and a colour flat of 40 x 40, made of other frames, are brought to the size of the lights.
_SMALL = """small AS MATERIALIZED (SELECT y % 24 AS y, x % 24 AS x, 0 AS stack_id, 0 AS frame_id, 0 AS c, avg(v) AS v FROM px WHERE frame_id < 3 GROUP BY ALL),
large AS MATERIALIZED (SELECT y + 8 * d AS y, x + 8 * d AS x, 0 AS stack_id, 0 AS frame_id, c, avg(v) AS v FROM px, range(2) r(d) WHERE frame_id IN (3, 4) GROUP BY ALL),
dark AS (SELECT y, x, v AS d FROM ({small})), flat AS (SELECT y, x, c, v / (SELECT avg(v) FROM large) AS f FROM ({large})),
pair AS (SELECT frame_id, v, d FROM px JOIN dark USING (y, x) WHERE frame_id > 4 AND v > 0 AND d > 0),
fit AS (SELECT frame_id, CASE WHEN any_value(n) >= 100 AND count(*) >= 100 AND var_pop(d) >= 1e-6 THEN least(greatest(regr_slope(v, d), 0.5), 2) ELSE 1 END AS k
  FROM pair JOIN (SELECT frame_id, quantile_cont(v, 0.4) AS cut, count(*) AS n FROM pair GROUP BY 1) USING (frame_id) WHERE v <= cut GROUP BY 1)"""


def _other_sizes(s: SparkSession, d: str) -> DataFrame:
    px = V.line_px(s, d)
    dark = px.filter("frame_id < 3").groupBy((F.col("y") % 24).alias("y"), (F.col("x") % 24).alias("x")).agg(F.avg("v").alias("v"))
    moved = px.filter("frame_id in (3, 4)").withColumn("d", F.explode(F.array(F.lit(0), F.lit(8)))).select((F.col("y") + F.col("d")).alias("y"), (F.col("x") + F.col("d")).alias("x"), "c", "v")
    large = moved.groupBy("y", "x", "c").agg(F.avg("v").alias("v"))
    flat = large.crossJoin(F.broadcast(large.agg(F.avg("v").alias("mean")))).select("y", "x", "c", (F.col("v") / F.col("mean")).alias("v"))
    return C.calibrate(px.filter("frame_id > 4"), dark, flat, least=100)


# Neighbourhoods.

_IMAGE = "img AS MATERIALIZED (SELECT stack_id, 0 AS frame_id, y, x, c, avg(v) AS v FROM px GROUP BY ALL)"


def _image(s: SparkSession, d: str) -> DataFrame:
    return stacking.stack(V.line_px(s, d), "mean", prereject=False).withColumn("frame_id", F.lit(0))


def _mono(s: SparkSession, d: str) -> DataFrame:
    return V.sky_px(s, d).filter("c = 0")


def _filled(s: SparkSession, d: str) -> DataFrame:
    """The mean image with 0.5 where no frame has a pixel."""
    places = s.range(V.SIDE * V.SIDE).select((F.col("id") / V.SIDE).cast("int").alias("y"), (F.col("id") % V.SIDE).cast("int").alias("x"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"))
    return places.join(_image(s, d).select("y", "x", "c", "v"), ["y", "x", "c"], "left").select(F.lit(0).alias("stack_id"), F.lit(0).alias("frame_id"), "y", "x", "c", F.coalesce("v", F.lit(0.5)).alias("v"))


def _axis(n: int, to: int) -> str:
    at = f"(o * {(n - 1)} / {to - 1})"
    low = f"least(floor({at}), {n - 2})"
    return f"(SELECT o, ({low} + k)::INT AS i, CASE k WHEN 0 THEN 1 - ({at} - {low}) ELSE {at} - {low} END AS w FROM range({to}) a(o), range(2) b(k))"


def _resized(source: str, n: int, h: int, w: int, rounded: bool = True) -> str:
    y = f"(SELECT {IMG}, x, o::INT AS y, sum(w * v) / sum(w) AS v FROM {source} JOIN {_axis(n, h)} ON y = i WHERE w > 0 GROUP BY ALL)"
    value = "round(sum(w * v) / sum(w), 6)" if rounded else "sum(w * v) / sum(w)"
    return f"SELECT {IMG}, y, o::INT AS x, {value} AS v FROM {y} JOIN {_axis(n, w)} ON x = i WHERE w > 0 GROUP BY ALL"


query("resize_bilinear", O.query(O.LINE, _IMAGE, select=_resized("img", 32, 48, 40)))(lambda s, d: N.resize(_image(s, d), LINE_SIZE, (48, 40)))
query("zoom_before_solve", O.query(O.LINE, _IMAGE, select=_resized("(SELECT stack_id, frame_id, y, x, 0 AS c, avg(v) AS v FROM img GROUP BY ALL)", 32, 38, 38)))(
    lambda s, d: N.resize(_image(s, d).groupBy("stack_id", "frame_id", "y", "x").agg(F.lit(0).alias("c"), F.avg("v").alias("v")), LINE_SIZE, (38, 38))
)
query("calibrate_other_sizes", O.query(O.LINE, _SMALL.replace("{small}", _resized("small", 24, 32, 32, False)).replace("{large}", _resized("large", 40, 32, 32, False)), select="""SELECT stack_id, frame_id, y, x, c,
  round((v - coalesce(k, 1) * coalesce(d, 0)) / CASE WHEN f > 0.01 THEN f ELSE 1 END, 6) AS v
  FROM (SELECT * FROM px WHERE frame_id > 4) LEFT JOIN fit USING (frame_id) LEFT JOIN dark USING (y, x) LEFT JOIN flat USING (y, x, c)"""))(lambda s, d: _other_sizes(s, d))  # fmt: skip
_ZOOMED = """zy(o, i, w) AS ({0}), zx(o, i, w) AS ({1}),
down AS (SELECT stack_id, frame_id, c, x, o AS y, sum(w * v) / sum(w) AS v FROM full_img JOIN zy ON y = i GROUP BY ALL)"""
query("zoom_cubic", O.query(O.LINE, _IMAGE, "full_img AS (SELECT 0 AS stack_id, 0 AS frame_id, y, x, c, coalesce(v, 0.5) AS v FROM (SELECT y::INT AS y, x::INT AS x, c FROM range(32) a(y), range(32) b(x), (SELECT unnest([0, 1, 2]) AS c)) LEFT JOIN img USING (y, x, c))",
  _ZOOMED.format(O.spline_table(32, 48), O.spline_table(32, 40)), select=f"SELECT {IMG}, y, o AS x, round(sum(w * v) / sum(w), 6) AS v FROM down JOIN zx ON x = i GROUP BY ALL"))(lambda s, d: N.resize(_filled(s, d), LINE_SIZE, (48, 40), 3))
for _pattern, _sites in N.PATTERNS.items():
    _of = lambda y, x, p=_sites: f"CASE WHEN {y} % 2 = 0 THEN CASE WHEN {x} % 2 = 0 THEN {p[0]} ELSE {p[1]} END ELSE CASE WHEN {x} % 2 = 0 THEN {p[2]} ELSE {p[3]} END END"
    _sql = f"""SELECT 0 AS stack_id, frame_id, col AS c, oy::INT AS y, ox::INT AS x, round(avg(v) FILTER (WHERE {_of('y', 'x')} = col), 6) AS v
      FROM (SELECT oy, ox, least(greatest(oy + dy, 0), 63) AS y, least(greatest(ox + dx, 0), 63) AS x FROM range(64) a(oy), range(64) b(ox), range(-1, 2) e(dy), range(-1, 2) f(dx))
      JOIN (SELECT frame_id, y, x, v FROM px WHERE c = {_of('y', 'x')}) USING (y, x), (SELECT unnest([0, 1, 2]) AS col) GROUP BY ALL"""
    query(f"debayer_{_pattern.lower()}", O.query(O.SKY, select=_sql))(lambda s, d, p=_pattern: N.debayer(V.sky_mosaic(s, d, p), SYNTH_SIZE, p))

_OUT = f"SELECT {IMG}, y, x, round(v, 6) AS v FROM "
query("gaussian_blur", O.query(O.LINE, _IMAGE, O.blur("img", "b", "2.5", 32, IMG), select=_OUT + "b"))(lambda s, d: N.gaussian_blur(_image(s, d), LINE_SIZE, 2.5))
for _name, _amount in P.SHARPEN.items():
    _sql = f"SELECT {IMG}, y, x, round(i.v + {_amount} * least(greatest(i.v - b.v, 0), 0.15 * i.v), 6) AS v FROM img i JOIN b USING ({IMG}, y, x)"
    query(f"sharpen_{_name}", O.query(O.LINE, _IMAGE, O.blur("img", "b", "(3.5 / 2.3548)", 32, IMG), select=_sql))(lambda s, d, k=_name: P.sharpen(_image(s, d), LINE_SIZE, 3.5, k))
query("median3x3", O.query(O.MONO, select=f"""SELECT {IMG}, oy::INT AS y, ox::INT AS x, round(median(v), 6) AS v FROM (
  SELECT oy, ox, least(greatest(oy + dy, 0), 63) AS y, least(greatest(ox + dx, 0), 63) AS x FROM range(64) a(oy), range(64) b(ox), range(-1, 2) e(dy), range(-1, 2) f(dx))
  JOIN mono USING (y, x) GROUP BY ALL"""))(lambda s, d: N.median_3x3(_mono(s, d), SYNTH_SIZE))  # fmt: skip
query("local_maxima", O.query(O.MONO, O.maxima("mono", "p", 3, 64), select="SELECT stack_id, frame_id, y, x, c, round(v, 6) AS v FROM p WHERE v > 0.15"))(lambda s, d: N.local_maxima(_mono(s, d), SYNTH_SIZE, 3, 0.15))
_DETECT = """flat AS MATERIALIZED (SELECT stack_id, frame_id, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM mono WINDOW w AS (PARTITION BY frame_id))"""
query("source_detect", O.query(O.MONO, _DETECT, O.blur("flat", "b", "2.5", 64, "stack_id, frame_id"), O.maxima("b", "p", 5, 64), select="""SELECT stack_id, frame_id, x, y, round(f.v, 6) AS v
  FROM p JOIN flat f USING (stack_id, frame_id, y, x) JOIN (SELECT frame_id, greatest(median(v) + 0.9 * stddev_pop(v), 0.01) AS t FROM b GROUP BY 1) USING (frame_id) WHERE p.v > t"""))(lambda s, d: N.detect_sources(_mono(s, d).drop("c"), SYNTH_SIZE))  # fmt: skip

# Background, colour, crops.

query("background_grid", O.query(O.SKY, O.background("px", "bg", 64, 6), select=f"SELECT {IMG}, cy AS y, cx AS x, round(v, 6) AS v FROM bg_g"))(lambda s, d: B.cell_sky(V.sky_px(s, d), SYNTH_SIZE))
_FLAT = f"flat AS MATERIALIZED (SELECT {IMG}, y, x, v - bg AS v FROM px JOIN bg USING ({IMG}, y, x))"
_PED = f"ped AS MATERIALIZED (SELECT {IMG}, list_sort(list(v))[count(*) // 1000 + 1] AS p FROM flat GROUP BY ALL)"
query("remove_gradient_mono", O.query(O.MONO.replace("mono AS", "all_px AS").replace("px AS", "rgb AS", 1).replace("all_rgb", "all_px").replace("FROM px WHERE", "FROM rgb WHERE").replace("all_px AS", "px AS"), O.background("px", "bg", 64, 6), _FLAT, _PED, select=f"SELECT {IMG}, y, x, round(greatest(v - p, 0), 6) AS v FROM flat JOIN ped USING ({IMG})"))(
    lambda s, d: B.remove_gradient(_mono(s, d), SYNTH_SIZE)
)
_RGB = f"""light AS MATERIALIZED (SELECT stack_id, frame_id, y, x, avg(v) AS v FROM flat GROUP BY ALL),
ped AS (SELECT stack_id, frame_id, list_sort(list(v))[count(*) // 1000 + 1] AS p FROM light GROUP BY ALL),
low AS MATERIALIZED (SELECT {IMG}, y, x, greatest(v - p, 0) AS v FROM flat JOIN ped USING (stack_id, frame_id)),
{{corners}},
sky AS (SELECT {IMG}, coalesce(s, 0) AS s FROM (SELECT DISTINCT {IMG} FROM low) LEFT JOIN (SELECT {IMG}, median(v) AS s FROM cor WHERE v >= 0 GROUP BY ALL) USING ({IMG}))"""
_RGB_OUT = f"SELECT {IMG}, y, x, round(greatest(v - (s - m), 0), 6) AS v FROM low JOIN sky USING ({IMG}) JOIN (SELECT stack_id, frame_id, min(s) AS m FROM sky GROUP BY ALL) USING (stack_id, frame_id)"
query("remove_gradient_rgb", O.query(O.SKY, O.background("px", "bg", 64, 6), _FLAT, _RGB.format(corners=O.corners("low", "cor", 64)), select=_RGB_OUT))(lambda s, d: B.remove_gradient(V.sky_px(s, d), SYNTH_SIZE, colour=True))
query("local_normalise", O.query(O.LINE, O.background("px", "bg", 32, 12), _FLAT, _PED, select=f"SELECT {IMG}, y, x, round(greatest(v - p, 0), 6) AS v FROM flat JOIN ped USING ({IMG})"))(
    lambda s, d: B.local_normalise(V.line_px(s, d), LINE_SIZE)
)
_FACTORS = f"""low AS (SELECT *, count(*) FILTER (WHERE v >= 0) OVER (PARTITION BY {IMG}) AS n FROM cor),
fac AS MATERIALIZED (SELECT {IMG}, CASE WHEN m < 1e-8 THEN 1 ELSE m / greatest(s, 1e-8) END AS factor FROM (
  SELECT *, avg(s) OVER (PARTITION BY stack_id, frame_id) AS m FROM (
    SELECT {IMG}, CASE WHEN n < 10 THEN 0 ELSE sky END AS s FROM (SELECT DISTINCT {IMG}, n FROM low) LEFT JOIN cs USING ({IMG}))))"""
_BAL = [O.SKY, O.corners("px", "cor", 64), O.sky("(SELECT * FROM cor WHERE v >= 0)", "cs", IMG, "2.5"), _FACTORS]
query("colour_balance_factors", O.query(*_BAL, select=f"SELECT {IMG}, round(factor, 6) AS factor FROM fac"))(lambda s, d: B.balance_factors(V.sky_px(s, d), SYNTH_SIZE))
query("colour_balance_auto", O.query(*_BAL, select=f"SELECT {IMG}, y, x, round(greatest(v * factor, 0), 6) AS v FROM px JOIN fac USING ({IMG})"))(lambda s, d: B.auto_balance(V.sky_px(s, d), SYNTH_SIZE))
query("colour_balance_manual", O.query(O.LINE, select="SELECT stack_id, frame_id, y, x, c, round(greatest(v * CASE c WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.75 END, 0), 6) AS v FROM px"))(
    lambda s, d: B.manual_balance(V.line_px(s, d), 1.5, 1.0, 0.75)
)
_FRAME = "edged AS MATERIALIZED (SELECT * EXCLUDE v, CASE WHEN y BETWEEN 5 AND 50 AND x BETWEEN 9 AND 60 THEN v WHEN y < 3 THEN 0 END AS v FROM px)"


def _edged(s: SparkSession, d: str) -> DataFrame:
    inside = F.col("y").between(5, 50) & F.col("x").between(9, 60)
    return V.sky_px(s, d).withColumn("v", F.when(inside, F.col("v")).when(F.col("y") < 3, 0.0))


query("auto_crop", O.query(O.SKY, _FRAME, select="""SELECT stack_id, frame_id, (y - y0)::INT AS y, (x - x0)::INT AS x, c, round(v, 6) AS v FROM edged, (
  SELECT min(y) + 2 AS y0, max(y) - 2 AS y1, min(x) + 2 AS x0, max(x) - 2 AS x1 FROM (SELECT y, x FROM edged GROUP BY ALL HAVING count(v) = count(*) AND max(v) > 0))
  WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"""))(lambda s, d: G.auto_crop(_edged(s, d), colour=True))  # fmt: skip
query("manual_crop", O.query(O.SKY, select="SELECT stack_id, frame_id, (y - 8)::INT AS y, (x - 20)::INT AS x, c, round(v, 6) AS v FROM px WHERE y >= 8 AND y < 40 AND x >= 20 AND x < 44"))(lambda s, d: G.crop(V.sky_px(s, d), 8, 20, 32, 24))
query("trim_shapes", O.query(O.LINE, select="""SELECT stack_id, frame_id, y, x, c, round(v, 6) AS v FROM px, (
  SELECT min(h) AS h, min(w) AS w FROM (SELECT max(y) AS h, max(x) AS w FROM px WHERE y <= 20 + frame_id GROUP BY frame_id)) WHERE y <= 20 + frame_id AND y <= h AND x <= w"""))(
    lambda s, d: G.trim_frames(V.line_px(s, d).filter("y <= 20 + frame_id"))
)
query("union_corners", O.query(O.LINE, O.corners("px", "cor", 32), select="SELECT c, count(*) AS n, round(sum(v), 6) AS v FROM cor GROUP BY 1"))(
    lambda s, d: B.corners(V.line_px(s, d), LINE_SIZE).groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
)

# Frames.

_SCORES = """scores AS MATERIALIZED (SELECT frames.*, n < 3 OR (fwhm <= wide AND eccentricity <= least(long, 0.8)) AS keep FROM frames, (
  SELECT median(fwhm) + 2 * stddev_pop(fwhm) AS wide, median(eccentricity) + 2 * stddev_pop(eccentricity) AS long, count(*) AS n FROM frames))"""
_scores = lambda s, d: quality.guarded(quality.score_frames(V.event_frames(s, d)))
_ids = lambda s, d: V.event_frames(s, d).select("frame_id", "n_stars")
query("frame_scores", O.query(O.FRAMES, _SCORES, select="SELECT frame_id, round(fwhm, 6) AS fwhm, n_stars, round(eccentricity, 6) AS eccentricity, round(roundness, 6) AS roundness, keep FROM scores"))(_scores)
query("frame_reject_semi", O.query(O.FRAMES, _SCORES, select="SELECT frame_id, n_stars FROM frames SEMI JOIN (SELECT frame_id FROM scores WHERE keep) USING (frame_id)"))(lambda s, d: quality.accepted(_ids(s, d), _scores(s, d)))
query("frame_reject_anti", O.query(O.FRAMES, _SCORES, select="SELECT frame_id, n_stars FROM frames ANTI JOIN (SELECT frame_id FROM scores WHERE keep) USING (frame_id)"))(lambda s, d: quality.rejected(_ids(s, d), _scores(s, d)))
query("frame_counts", O.query(O.FRAMES, _SCORES, select="SELECT count(*) FILTER (WHERE keep) AS accepted, count(*) FILTER (WHERE NOT keep) AS rejected, count(*) AS total FROM scores"))(lambda s, d: quality.frame_counts(_scores(s, d)))
query("median_fwhm", O.query(O.FRAMES, select="SELECT round(2 * coalesce(median(fwhm), 2.5), 6) AS fwhm FROM frames"))(lambda s, d: quality.median_fwhm(V.event_frames(s, d), 2))
query("psf_weights", O.query(O.FRAMES, select="SELECT frame_id, round(roundness / greatest(fwhm, 0.1), 6) AS w FROM frames"))(lambda s, d: quality.psf_weights(V.event_frames(s, d)))

# Display.

_LIGHT = "light AS MATERIALIZED (SELECT stack_id, y, x, 0.299 * max(v) FILTER (WHERE c = 0) + 0.587 * max(v) FILTER (WHERE c = 1) + 0.114 * max(v) FILTER (WHERE c = 2) AS v FROM img GROUP BY ALL)"
_stack = lambda s, d: stacking.stack(V.line_px(s, d), "mean", prereject=False)
query("luminance", O.query(O.LINE, _IMAGE, _LIGHT, select="SELECT stack_id, y, x, round(v, 6) AS v FROM light"))(lambda s, d: D.luminance(_stack(s, d), ["stack_id"]))
query("auto_stretch_rgb", O.query(O.LINE, _IMAGE, _LIGHT, O.STRETCH_PARAMS, select=O.STRETCHED))(lambda s, d: D.auto_stretch(_stack(s, d), ["stack_id"], colour=True))
_EMB_IMAGE = "img AS MATERIALIZED (SELECT stack_id, y, x, c, avg(v) AS v FROM px GROUP BY ALL), light AS (SELECT * FROM img)"
_emb = lambda s, d: stacking.stack(V.emb_px(s, d), "mean", prereject=False)
query("auto_stretch_mono", O.query(O.EMB, _EMB_IMAGE, O.STRETCH_PARAMS, select=O.STRETCHED))(lambda s, d: D.auto_stretch(_emb(s, d), ["stack_id"]))
query("locked_stretch", O.query(O.LINE, "img AS (SELECT * FROM px WHERE frame_id = 1)", "light AS (SELECT * FROM px WHERE frame_id = 0 AND c = 0)", O.STRETCH_PARAMS, select=O.STRETCHED))(
    lambda s, d: D.apply_stretch(V.line_px(s, d).filter("frame_id = 1").drop("frame_id"), D.stretch_params(V.line_px(s, d).filter("frame_id = 0 and c = 0"), ["stack_id"]), ["stack_id"])
)
query("linear_stretch", O.query(O.LINE, _IMAGE, select="""SELECT stack_id, y, x, c, CASE WHEN b > a THEN floor(least(greatest((v - a) / nullif(b - a, 0), 0), 1) * 255)::INT ELSE 0 END AS v
  FROM img JOIN (SELECT stack_id, quantile_cont(v, 0.005) AS a, quantile_cont(v, 0.995) AS b FROM img GROUP BY 1) USING (stack_id)"""))(lambda s, d: D.linear_stretch(_stack(s, d), ["stack_id"]))  # fmt: skip
query("mtf", """WITH g AS (SELECT p_partkey, (p_retailprice % 100 + 0.5::DOUBLE) / 101 AS x, (p_size % 10 * 2 + 1) / 20 AS m FROM part)
SELECT p_partkey, round(least(greatest((m - 1) * x / ((m * 2 - 1) * x - m), 0), 1), 6) AS v, round(least(greatest(x * (m - 1) / (m * x * 2 - m - x), 0.001), 0.999), 6) AS b FROM g""")(
    lambda s, d: V.table(s, d, "part").select("p_partkey", ((F.col("p_retailprice") % 100 + 0.5) / 101).alias("x"), ((F.col("p_size") % 10 * 2 + 1) / 20).alias("m"))
    .select("p_partkey", D.midtone_transfer(F.col("x"), F.col("m")).alias("v"), D.midtone_balance(F.col("x"), F.col("m")).alias("b"))
)
query("histogram_mono", O.query(O.EMB, select="""SELECT stack_id, least(floor((v - a) / (b - a) * 256), 255)::INT AS bin, count(*) AS n
  FROM px JOIN (SELECT stack_id, min(v) AS a, max(v) AS b FROM px GROUP BY 1) USING (stack_id) WHERE b > a GROUP BY ALL"""))(lambda s, d: D.histogram(V.emb_px(s, d), ["stack_id"]))
query("histogram_rgb", O.query(O.LINE, select="SELECT c, least(floor(v * 256), 255)::INT AS bin, count(*) AS n FROM px WHERE v BETWEEN 0 AND 1 GROUP BY ALL"))(lambda s, d: D.histogram(V.line_px(s, d), ["c"], limits=(0.0, 1.0)))
query("image_stats", O.query(O.LINE, select="SELECT frame_id, c, round(min(v), 6) AS low, round(max(v), 6) AS top, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM px GROUP BY ALL"))(lambda s, d: D.image_stats(V.line_px(s, d), ["frame_id", "c"]))
# Each user's width of a star, rounded, as a kernel: its peak, its sum about the peak and its size.
query("moffat_kernel", O.query(O.FRAMES, """w AS (SELECT frame_id, 1 + floor(fwhm) % 5 + 2e-1 AS width FROM frames),
k AS (SELECT frame_id, dy, dx, pow(1 + (dy*dy + dx*dx) / pow(width / (2 * sqrt(pow(2, 1 / 3.5) - 1)), 2), -3.5) AS v FROM w, range(-12, 13) a(dy), range(-12, 13) b(dx)
  WHERE greatest(abs(dy), abs(dx)) <= greatest(7, CASE WHEN floor(4 * width) % 2 = 1 THEN floor(4 * width) ELSE floor(4 * width) + 1 END) // 2)""", select="""SELECT frame_id, count(*) AS n, round(max(v) / sum(v), 6) AS peak,
  round(sum(v) FILTER (WHERE dy*dy + dx*dx <= 4) / sum(v), 6) AS near FROM k GROUP BY 1"""))(lambda s, d: _kernels(s, d))


def _kernels(s: SparkSession, d: str) -> DataFrame:
    kernel = F.lit(None).cast("array<struct<dy:int,dx:int,w:double>>")
    for k in range(5):
        kernel = F.when(F.floor("fwhm") % 5 == k, D.moffat_kernel(k + 1.2)).otherwise(kernel)
    cells = V.event_frames(s, d).select("frame_id", F.inline(kernel))
    near = F.when(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= 4, F.col("w"))
    return cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("peak"), F.sum(near).alias("near"))


# Star reduction.

_STARS = f"""light AS MATERIALIZED (SELECT stack_id, frame_id, y, x, avg(v) AS v FROM px GROUP BY ALL),
{O.blur('light', 'lb', '3.0', 64, 'stack_id, frame_id')},
hp AS MATERIALIZED (SELECT stack_id, frame_id, y, x, l.v - lb.v AS v FROM light l JOIN lb USING (stack_id, frame_id, y, x)),
{O.maxima('hp', 'pk', 3, 64)},
spot AS MATERIALIZED (SELECT stack_id, frame_id, y, x, CASE WHEN p.v > t THEN 1 ELSE 0 END::DOUBLE AS v FROM hp LEFT JOIN pk p USING (stack_id, frame_id, y, x)
  JOIN (SELECT frame_id, greatest(2 * 1.4826 * median(abs(v)), 0.002 * max(v)) AS t FROM hp GROUP BY 1) USING (frame_id)),
{O.blur('spot', 'mk', '10.5', 64, 'stack_id, frame_id')},
{O.blur('px', 'nb', '25.0', 64, IMG)},
{O.blur('px', 'fb', '100.0', 64, IMG)}"""
query("star_reduce", O.query(O.SKY, _STARS, select=f"""SELECT {IMG}, y, x, round(greatest(v - 0.5 * m * greatest(v - (n * (1 - m) + f * m), 0), 0), 6) AS v FROM (
  SELECT {IMG}, y, x, px.v, nb.v AS n, fb.v AS f, least(greatest(mk.v * 2 * pi() * 10.5 * 10.5, 0), 1) AS m
  FROM px JOIN nb USING ({IMG}, y, x) JOIN fb USING ({IMG}, y, x) JOIN mk USING (stack_id, frame_id, y, x))"""))(lambda s, d: P.reduce_stars(V.sky_px(s, d), SYNTH_SIZE, 0.5))  # fmt: skip

# Mosaic: two overlapping halves of the mean of the made-up frames as panels on the sky.

def _to_sky(x: str, y: str, p: str) -> str:
    """SQL for ra, dec of a pixel; ``p`` prefixes the columns px0, px1, r0, d0, a, b, e, f of a panel."""
    xi = f"radians(({x} + 1 - {p}px0) * {p}a + ({y} + 1 - {p}px1) * {p}b)"
    eta = f"radians(({x} + 1 - {p}px0) * {p}e + ({y} + 1 - {p}px1) * {p}f)"
    below = f"(cos(radians({p}d0)) - {eta} * sin(radians({p}d0)))"
    ra = f"({p}r0 + degrees(atan2({xi}, {below})))"
    dec = f"degrees(atan2(sin(radians({p}d0)) + {eta} * cos(radians({p}d0)), sqrt(pow({xi}, 2) + pow({below}, 2))))"
    return f"{ra} AS ra, {dec} AS dec"


_PANEL_SQL = f"""sky AS (SELECT {_to_sky('cx', 'cy', '')} FROM (SELECT *, i * (width - 1) AS cx, j * (height - 1) AS cy FROM panels, range(2) q(i), range(2) u(j))),
step AS (SELECT min(sqrt(pow((n.ra - h.ra) * cos(radians(h.dec)), 2) + pow(n.dec - h.dec, 2))) AS s
  FROM (SELECT panel_id, {_to_sky('width / 2', 'height / 2', '')} FROM panels) h JOIN (SELECT panel_id, {_to_sky('(width / 2 + 1)', 'height / 2', '')} FROM panels) n USING (panel_id)),
grid AS MATERIALIZED (SELECT ow, oh, ow / 2 AS opx0, oh / 2 AS opx1, or0, od0, -s AS oa, 0e0 AS ob, 0e0 AS oe, s AS of FROM (
  SELECT (floor(1.05 * (max(ra) - min(ra)) * cos(radians((min(dec) + max(dec)) / 2)) / any_value(s)) + 1)::INT AS ow, (floor(1.05 * (max(dec) - min(dec)) / any_value(s)) + 1)::INT AS oh,
         (min(ra) + max(ra)) / 2 AS or0, (min(dec) + max(dec)) / 2 AS od0, any_value(s) AS s FROM sky, step))"""
_BACK = """place AS MATERIALIZED (SELECT *, px0 - 1 + (xi * f - eta * b) / (a * f - b * e) AS ix, px1 - 1 + (eta * a - xi * e) / (a * f - b * e) AS iy FROM (
  SELECT *, degrees(cos(radians(dec)) * sin(radians(ra - r0)) / below) AS xi, degrees((sin(radians(dec)) * cos(radians(d0)) - cos(radians(dec)) * sin(radians(d0)) * cos(radians(ra - r0))) / below) AS eta FROM (
    SELECT *, sin(radians(dec)) * sin(radians(d0)) + cos(radians(dec)) * cos(radians(d0)) * cos(radians(ra - r0)) AS below FROM out, panels)))"""
_MOSAIC = [O.PANELS, _PANEL_SQL, f"""out AS (SELECT oy, ox, {_to_sky('ox', 'oy', 'o')} FROM (SELECT *, unnest(range(oh)) AS oy FROM grid) CROSS JOIN (SELECT unnest(range(ow)) AS ox FROM grid))""", _BACK, """hit AS MATERIALIZED (
  SELECT panel_id, oy, ox, width, height, (floor(iy) + j)::INT AS y, (floor(ix) + i)::INT AS x,
         CASE i WHEN 1 THEN ix - floor(ix) ELSE 1 - (ix - floor(ix)) END * CASE j WHEN 1 THEN iy - floor(iy) ELSE 1 - (iy - floor(iy)) END AS k
  FROM place, range(2) q(i), range(2) u(j) WHERE ix >= 0 AND ix < width - 1 AND iy >= 0 AND iy < height - 1)""", """rep AS (
  SELECT h.panel_id, oy, ox, c, sum(k * v) AS v, sum(k * least((h.y + 1) / 30, (height - h.y) / 30, (h.x + 1) / 30, (width - h.x) / 30, 1)) AS w
  FROM hit h JOIN px ON px.panel_id = h.panel_id AND px.y = h.y AND px.x = h.x GROUP BY ALL)"""]  # fmt: skip
query("feather_weights", O.query(O.SKY, select="SELECT y, x, round(least((y + 1) / 30, (64 - y) / 30, (x + 1) / 30, (64 - x) / 30, 1), 6) AS w FROM px WHERE c = 0"))(
    lambda s, d: _mono(s, d).select("y", "x", M.feather(F.col("y"), F.col("x"), F.lit(64), F.lit(64)).alias("w"))
)
query("mosaic_grid", O.query(O.PANELS, _PANEL_SQL, select="SELECT ow AS o_width, oh AS o_height, round(or0, 6) AS ra, round(od0, 6) AS dec, round(of * 1000, 6) AS step FROM grid"))(
    lambda s, d: M.output_grid(V.nation_panels(s, d)[1]).select("o_width", "o_height", F.col("o_crval")[0].alias("ra"), F.col("o_crval")[1].alias("dec"), (F.col("o_cd")[3] * 1000).alias("step"))
)
query("mosaic_blend", O.query(*_MOSAIC, select="SELECT oy::INT AS y, ox::INT AS x, c, round(coalesce(sum(v * w) / nullif(sum(w), 0), 0), 6) AS v FROM rep GROUP BY ALL"))(lambda s, d: M.build_mosaic(*V.nation_panels(s, d)))

# Selections and sets.

query("top_stars", O.query(O.SKY, select="SELECT frame_id, c, y, x, round(v, 6) AS v, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, c ORDER BY v DESC, y, x) AS rank FROM px) WHERE rank <= 60"))(
    lambda s, d: sets.top_k(V.sky_px(s, d).select("frame_id", "c", "y", "x", "v"), ["frame_id", "c"], [F.desc("v"), F.col("y"), F.col("x")], 60)
)
_CORNERS = """inside AS MATERIALIZED (SELECT stack_id, frame_id, c, k AS corner, (y - ty)::INT AS y, (x - lx)::INT AS x, ty, lx, v
  FROM px JOIN (VALUES (0, 0, 0), (1, 0, 48), (2, 48, 0), (3, 48, 48)) q(k, ty, lx) ON y BETWEEN ty AND ty + 15 AND x BETWEEN lx AND lx + 15)"""
query("corner_glow", O.query(O.SKY, _CORNERS, O.background("inside", "bg", 16, 8, f"{IMG}, corner"), select=f"""SELECT {IMG}, (y + ty)::INT AS y, (x + lx)::INT AS x, round(greatest(v - bg, 0), 6) AS v FROM inside JOIN bg USING ({IMG}, corner, y, x)
  UNION ALL SELECT {IMG}, y, x, round(v, 6) FROM px WHERE y BETWEEN 16 AND 47 OR x BETWEEN 16 AND 47"""))(lambda s, d: B.clean_corners(V.sky_px(s, d), SYNTH_SIZE))
query("kth_pedestal", O.query(O.LINE, select="SELECT frame_id, c, round(list_sort(list(v))[count(*) // 100 + 1], 6) AS pedestal FROM px GROUP BY ALL"))(lambda s, d: B.kth_smallest(V.line_px(s, d), ["frame_id", "c"], per=100))
query("ordered_distinct", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(
    lambda s, d: sets.ordered_distinct(V.table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
)
query("path_minus", "SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")(
    lambda s, d: sets.append_new(V.table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), V.table(s, d, "customer").select("c_custkey"), "c_custkey", "c_custkey")
)

# Astrometry.

_numbers = lambda s, d: V.table(s, d, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 360000 / 1000.0 + 0.0001).alias("ra"), ((F.col("p_partkey") * 104729 % 180000) / 1000.0 - 90 + 0.0002).alias("dec"))
_NUMBERS = "n AS (SELECT p_partkey, p_partkey * 7919 % 360000 / 1e3 + 1e-4 AS ra, p_partkey * 104729 % 180000 / 1e3 - 90 + 2e-4 AS dec FROM part)"
_HMS = "printf('%02dh %02dm %05.2fs', trunc({0} / 15)::INT, trunc(({0} / 15 - trunc({0} / 15)) * 60)::INT, ({0} / 15 - trunc({0} / 15) - trunc(({0} / 15 - trunc({0} / 15)) * 60) / 60e0) * 3600)"
_DMS = """printf('%s%02dd %02d%s %04.1f"', CASE WHEN {0} >= 0 THEN '+' ELSE '-' END, trunc(abs({0}))::INT, trunc((abs({0}) - trunc(abs({0}))) * 60)::INT, chr(39), (abs({0}) - trunc(abs({0})) - trunc((abs({0}) - trunc(abs({0}))) * 60) / 60e0) * 3600)"""
query("ra_hms", O.query(_NUMBERS, select=f"SELECT p_partkey, {_HMS.format('ra')} AS hms FROM n"))(lambda s, d: _numbers(s, d).select("p_partkey", A.ra_hms(F.col("ra")).alias("hms")))
query("dec_dms", O.query(_NUMBERS, select=f"SELECT p_partkey, {_DMS.format('dec')} AS dms FROM n"))(lambda s, d: _numbers(s, d).select("p_partkey", A.dec_dms(F.col("dec")).alias("dms")))
query("plate_scale", "SELECT p_partkey, round(x, 6) AS scale, round(x * 0.75, 3) AS low, round(x * 1.25, 3) AS high FROM (SELECT p_partkey, CASE WHEN p_size > 1 THEN 3.76 / (p_size * 1e1 + 0.37) * 206.265 END AS x FROM part)")(
    lambda s, d: V.table(s, d, "part").select("p_partkey", A.plate_scale(F.lit(3.76), F.when(F.col("p_size") > 1, F.col("p_size") * 10 + 0.37).otherwise(0.5)).alias("s")).select("p_partkey", "s.scale", "s.low", "s.high")
)
query("scale_hints", "SELECT p_partkey, round(p_retailprice / CASE p_size % 3 WHEN 0 THEN 1.2 ELSE 1 END / CASE p_size % 2 WHEN 0 THEN 2 ELSE 1 END, 6) AS hint FROM part")(
    lambda s, d: V.table(s, d, "part").select("p_partkey", A.scale_hint(F.col("p_retailprice"), F.when(F.col("p_size") % 3 == 0, "arcsecperpix").otherwise("degwidth"), F.col("p_size") % 2 == 0).alias("hint"))
)


_SOLUTION = """g AS (SELECT p_partkey, ra, dec, dec + 90.1 AS pa, p_size * 1e1 AS fw, p_size * 8e0 AS fh, p_retailprice / 1e3 AS scale, p_size % 2 = 0 AS flipped,
  CASE p_size % 3 WHEN 0 THEN 4656 ELSE 0 END AS w, CASE p_size % 3 WHEN 0 THEN 3520 ELSE 0 END AS h, p_name, p_retailprice FROM n JOIN part USING (p_partkey)),
pairs AS (SELECT p_partkey, unnest([
  {k: 'CTYPE1', n: NULL, t: 'RA---TAN'}, {k: 'CTYPE2', n: NULL, t: 'DEC--TAN'}, {k: 'EQUINOX', n: 2000e0, t: NULL}, {k: 'RADESYS', n: NULL, t: 'ICRS'}, {k: 'CRVAL1', n: ra, t: NULL},
  {k: 'CRVAL2', n: dec, t: NULL}, {k: 'OBJCTRA', n: NULL, t: {HMS}}, {k: 'OBJCTDEC', n: NULL, t: {DMS}}, {k: 'RA', n: ra, t: NULL}, {k: 'DEC', n: dec, t: NULL}, {k: 'PLTSOLVD', n: NULL, t: 'T'},
  {k: 'FLDWIDTH', n: fw, t: NULL}, {k: 'FLDHGHT', n: fh, t: NULL}, {k: 'PIXSCALE', n: scale * 1.2, t: NULL}, {k: 'PA', n: pa, t: NULL}]) AS u FROM g)""".replace("{HMS}", _HMS.format("ra")).replace("{DMS}", _DMS.format("dec"))


def _solution(s: SparkSession, d: str, wcs: Column) -> DataFrame:
    """Keywords of a made-up solution for each part."""
    parts = V.table(s, d, "part")
    rows = V.dealt(_numbers(s, d).join(parts, "p_partkey"), parts.count(), 20_000, "p_partkey")  # headers are much work for a row of a small file
    seen = F.col("p_size") % 3 == 0
    made = A.solution_header(
        F.col("ra"), F.col("dec"), F.col("dec") + 90.1, F.col("p_size") * 10.0, F.col("p_size") * 8.0, F.col("p_retailprice") / 1000, F.col("p_size") % 2 == 0, wcs,
        F.when(seen, 4656).otherwise(0), F.when(seen, 3520).otherwise(0))
    return rows.select("p_partkey", F.explode(made).alias("k", "v")).select("p_partkey", "k", F.col("v.number").alias("number"), F.col("v.text").alias("text"))


query("wcs_header", O.query(_NUMBERS, _SOLUTION, select="""SELECT p_partkey, u.k AS k, round(u.n, 6) AS number, u.t AS text FROM (SELECT * FROM pairs UNION ALL SELECT p_partkey, unnest([
  {k: 'CD1_1', n: -s * cos(radians(pa)) * flip, t: NULL}, {k: 'CD1_2', n: s * sin(radians(pa)), t: NULL}, {k: 'CD2_1', n: -s * sin(radians(pa)) * flip, t: NULL}, {k: 'CD2_2', n: -s * cos(radians(pa)), t: NULL},
  {k: 'CRPIX1', n: CASE WHEN w > 0 THEN w ELSE fw * 60 / (scale * 1.2) END / 2, t: NULL}, {k: 'CRPIX2', n: CASE WHEN h > 0 THEN h ELSE fh * 60 / (scale * 1.2) END / 2, t: NULL}])
  FROM (SELECT *, scale * 1.2 / 3600 AS s, CASE WHEN flipped THEN -1 ELSE 1 END AS flip FROM g))"""))(lambda s, d: _solution(s, d, F.lit(None).cast("map<string,string>")))  # fmt: skip


def _solver_header() -> Column:
    price = F.col("p_retailprice").cast("string")
    parts = {"SIMPLE": F.lit("T"), "COMMENT": F.lit("x"), "NAXIS1": F.lit("9"), "CRPIX1": price, "CRPIX2": F.lit("n/a"), "CD1_1": F.lit("0.00041"), "CD2_1": F.lit("-2.5e-06"), "CDELT1": price, "CRVAL1": price, "RADESYS": F.lit("FK5"), "OBJECT": F.col("p_name")}
    plain = {"CDELT1": price, "CDELT2": F.lit("2"), "IMAGEW": F.lit("5")}
    make = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)])
    return F.when(F.col("p_size") % 2 == 0, make(parts)).otherwise(make(plain))


query("solved_header", O.query(_NUMBERS, _SOLUTION, select="""SELECT p_partkey, k, round(n, 6) AS number, t AS text FROM (
  SELECT p_partkey, u.k AS k, u.n AS n, u.t AS t FROM pairs JOIN g USING (p_partkey) WHERE NOT (flipped AND u.k IN ('CRVAL1', 'RADESYS'))
  UNION ALL SELECT p_partkey, unnest(['CRPIX1', 'CRPIX2', 'CD1_1', 'CD2_1', 'CRVAL1', 'RADESYS', 'OBJECT']),
    unnest([p_retailprice / 1.2, NULL, 41e-5 * 1.2, -25e-7 * 1.2, p_retailprice, NULL, NULL]), unnest([NULL, 'n/a', NULL, NULL, NULL, 'FK5', p_name]) FROM g WHERE flipped
  UNION ALL SELECT p_partkey, unnest(['CDELT1', 'CDELT2']), unnest([p_retailprice * 1.2, 2 * 1.2::DOUBLE]), NULL FROM g WHERE NOT flipped)"""))(lambda s, d: _solution(s, d, _solver_header()))

# Names and kinds of objects, told apart in SQL by a rule of its own: what follows the first letter, trimmed, is of digits alone.
_OBJECT = """CASE p_size % 8 WHEN 0 THEN 'M' || p_partkey WHEN 1 THEN 'm 31 x' WHEN 2 THEN 'M2-9' WHEN 3 THEN 'M31a' WHEN 4 THEN 'NGC ' || p_partkey WHEN 5 THEN 'Main' WHEN 6 THEN 'M' || chr(9) || '45 ' ELSE 'm' END"""
query("annotation_class", f"""SELECT p_partkey, CASE WHEN starts_with(name, 'm ') OR (starts_with(name, 'm') AND len(trim(substr(name, 2), chr(9) || ' ')) > 0
    AND len(translate(trim(substr(name, 2), chr(9) || ' '), '0123456789', '')) = 0) THEN 'messier' WHEN list_contains(['ic', 'ngc', 'hd', 'bright_star', 'messier', 'other'], kind) THEN kind ELSE 'other' END AS class
  FROM (SELECT p_partkey, lower({_OBJECT}) AS name, lower(CASE p_partkey % 4 WHEN 0 THEN 'NGC' WHEN 1 THEN 'bright_star' WHEN 2 THEN 'ugc' ELSE 'IC' END) AS kind FROM part)""")(
    lambda s, d: V.table(s, d, "part").select("p_partkey", A.annotation_class(
        F.element_at(F.array(F.concat(F.lit("M"), "p_partkey"), F.lit("m 31 x"), F.lit("M2-9"), F.lit("M31a"), F.concat(F.lit("NGC "), "p_partkey"), F.lit("Main"), F.lit("M\t45 "), F.lit("m")), F.col("p_size") % 8 + 1),
        F.element_at(F.array(F.lit("NGC"), F.lit("bright_star"), F.lit("ugc"), F.lit("IC")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("class"))
)


@query("annotations_json", """SELECT event_id, 'k' AS name, (props::JSON->>'$.k')::DOUBLE AS pixel_x, 0e0 AS pixel_y, 30e0 AS radius, 'star' AS type FROM events
UNION ALL SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE 'Unknown' END, 0, 1.5, 2, CASE WHEN event_type = 'view' THEN 'view' ELSE '' END FROM events""")
def _annotations(s: SparkSession, d: str) -> DataFrame:
    first = F.concat(F.lit('{"names":["k","z"],"type":"star","pixelx":'), F.get_json_object("props", "$.k"), F.lit("}"))
    second = F.concat(F.lit('{"pixely":1.5,"radius":2'), F.when(F.col("event_type") == "view", ',"type":"view"').otherwise(""), F.lit("}"))
    text = F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))
    return V.table(s, d, "events").select("event_id", F.inline(A.annotations(text)))


_SESSION = [k for k, v in session.FIELDS.items() if not isinstance(v, list)]
_PLAIN = {"stacking_method": "'sigma_clip'", "sigma_low": "2.5::DOUBLE", "sigma_high": "2.5::DOUBLE", "percentile_low": "10::DOUBLE", "percentile_high": "10::DOUBLE", "camera_type": "'mono'", "bayer_pattern": "'RGGB'", "output_path": "'stacked.fits'", "reference_frame": "0", "denoise_strength": "'medium'", "deconv_strength": "'medium'", "master_dark_path": "''", "master_flat_path": "''"}
_GIVEN = {"stacking_method": "event_type", "sigma_low": "(props::JSON->>'$.k')::DOUBLE", "reference_frame": "CASE WHEN user_id % 2 = 0 THEN user_id END", "drizzle": "user_id % 3 = 0", "output_path": "CASE WHEN user_id % 2 = 0 THEN 'out.fits' END"}


@query("session_defaults", "SELECT event_id, " + ", ".join(f"coalesce({_GIVEN.get(k, 'NULL')}, {_PLAIN.get(k, 'false')}) AS {k}" for k in _SESSION) + " FROM events")
def _session(s: SparkSession, d: str) -> DataFrame:
    even = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(',"reference_frame":'), F.col("user_id"), F.lit(',"output_path":"out.fits"'))).otherwise(',"output_path":null')
    text = F.concat(F.lit('{"stacking_method":"'), F.col("event_type"), F.lit('","unknown":1,"sigma_low":'), F.get_json_object("props", "$.k"), F.lit(',"drizzle":'), (F.col("user_id") % 3 == 0).cast("string"), even, F.lit("}"))
    return V.table(s, d, "events").select("event_id", session.parse(text).alias("t")).select("event_id", *[f"t.{k}" for k in _SESSION])


@query("session_files", """SELECT c_custkey AS session_id, role, position, path FROM (
  SELECT c_custkey, 'light_paths' AS role, p - 1 AS position, p * 7 AS path FROM customer, range(1, 4) r(p) UNION ALL SELECT c_custkey, 'flat_paths', 0, c_custkey FROM customer)
  WHERE path IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)""")
def _session_files(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"light_paths":["7","14","21"],"flat_paths":["'), F.col("c_custkey"), F.lit('"]}'))
    rows = V.table(s, d, "customer").select(F.col("c_custkey").alias("session_id"), session.parse(text).alias("settings"))
    there = V.table(s, d, "supplier").filter("s_nationkey < 20").select(F.col("s_suppkey").cast("string").alias("path"))
    return session.present_files(rows, there).select("session_id", "role", "position", F.col("path").cast("long").alias("path"))


@query("fits_roundtrip", O.query(O.LINE, select="SELECT frame_id, y, x, c, round(v::FLOAT::DOUBLE, 6) AS v FROM px UNION ALL SELECT frame_id, y, x, c, NULL FROM (SELECT DISTINCT frame_id, y::INT AS y, x::INT AS x, c FROM (SELECT DISTINCT frame_id FROM px), range(32) a(y), range(32) b(x), range(3) k(c)) ANTI JOIN px USING (frame_id, y, x, c)"))
def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Frames written as FITS files and read back: 32-bit values, missing pixels NULL."""
    folder = shared_folder(s, "fits-roundtrip")
    px = V.line_px(s, d).select(F.concat(F.col("frame_id").cast("string"), F.lit(".fits")).alias("path"), "y", "x", "c", "v", *[F.lit(n).alias(k) for k, n in (("height", V.SIDE), ("width", V.SIDE), ("channels", 3))])
    fits.save_images(px, folder)
    back = s.read.format("fits").load(folder)
    return back.select(F.regexp_extract("path", r"(\d+)\.fits$", 1).cast("int").alias("frame_id"), "y", "x", "c", "v")


@query("xisf_roundtrip", O.query(O.LINE, select="SELECT frame_id, y, x, c, round(v::FLOAT::DOUBLE, 6) AS v FROM px UNION ALL SELECT frame_id, y, x, c, NULL FROM (SELECT DISTINCT frame_id, y::INT AS y, x::INT AS x, c FROM (SELECT DISTINCT frame_id FROM px), range(32) a(y), range(32) b(x), range(3) k(c)) ANTI JOIN px USING (frame_id, y, x, c)"))
def _xisf_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Frames written as compressed XISF files and read back: 32-bit values, missing pixels NULL."""
    folder = shared_folder(s, "xisf-roundtrip")
    px = V.line_px(s, d).select(F.concat(F.col("frame_id").cast("string"), F.lit(".xisf")).alias("path"), "y", "x", "c", "v", *[F.lit(n).alias(k) for k, n in (("height", V.SIDE), ("width", V.SIDE), ("channels", 3))])
    xisf.save_images(px, folder)
    return xisf.read_stored(s, folder).select(F.regexp_extract("path", r"(\d+)\.xisf$", 1).cast("int").alias("frame_id"), "y", "x", "c", "v")


@query("header_patch", O.query(O.LINE, select="""SELECT frame_id, k AS key, CASE k WHEN 'OBJECT' THEN n_name WHEN 'REGION' THEN n_regionkey::VARCHAR WHEN 'BITPIX' THEN '-32' ELSE 'kept' END AS value, n, v
  FROM (SELECT frame_id, count(v) AS n, round(sum(v::FLOAT::DOUBLE), 3) AS v FROM px GROUP BY 1) JOIN nation ON n_nationkey = frame_id, (SELECT unnest(['OBJECT', 'REGION', 'BITPIX', 'OBSERVER']) AS k)"""))
def _patched(s: SparkSession, d: str) -> DataFrame:
    """Nations' names and regions put into the headers of files that stay as they are otherwise."""
    folder = shared_folder(s, "header-patch")
    old = F.create_map(F.lit("OBSERVER"), F.lit("kept"), F.lit("OBJECT"), F.lit("old"))
    px = V.line_px(s, d).select(F.concat(F.col("frame_id").cast("string"), F.lit(".fits")).alias("path"), old.alias("header"), "y", "x", "c", "v")
    fits.save_images(px, folder)
    frames = V.line_px(s, d).select("frame_id").distinct()
    extra = F.create_map(F.lit("OBJECT"), F.col("n_name"), F.lit("REGION"), F.col("n_regionkey").cast("string"), F.lit("BITPIX"), F.lit("8"))
    named = V.table(s, d, "nation").join(frames, F.col("frame_id") == F.col("n_nationkey")).select(F.concat(F.col("frame_id").cast("string"), F.lit(".fits")).alias("path"), extra.alias("extra"))
    headers.patch_headers(named, folder)
    frame = F.regexp_extract("path", r"(\d+)\.fits$", 1).cast("int").alias("frame_id")
    heads = headers.read_headers(s, folder).select(frame, F.explode("header").alias("key", "value")).filter(F.col("key").isin("OBJECT", "REGION", "BITPIX", "OBSERVER"))
    sums = fits.read_stored(s, folder).groupBy(frame).agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("v"))
    return heads.join(sums, "frame_id")


query("bayer_of_header", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'GBRG' WHEN 1 THEN 'BGGR' WHEN 2 THEN 'RGGB' WHEN 3 THEN 'RGGB' END AS pattern FROM part""")(
    lambda s, d: V.table(s, d, "part").select("p_partkey", N.pattern_of_header(F.element_at(F.array(*[F.create_map(*[F.lit(x) for x in kv]) for kv in (
        ("BAYERPAT", " gbrg "), ("COLORTYP", "RGB", "BAYER", "BGGR"), ("BAYERPAT", "none", "CFA-PATT", "RGGB"), ("BAYERPAT", "RGGB", "COLORTYP", "BGGR"), ("OBJECT", "RGGB"), ("BAYERPAT", "RGBG"))]),
        F.col("p_size") % 6 + 1)).alias("pattern"))
)


query("wcs_merge", """SELECT n_nationkey, k, arg_max(v, over) AS v FROM (
  SELECT n_nationkey, unnest(['A', 'B']) AS k, unnest([n_name, 'old']) AS v, 0 AS over FROM nation
  UNION ALL SELECT n_nationkey, unnest(['B', 'C']), unnest([n_regionkey::VARCHAR, n_nationkey::VARCHAR]), 1 FROM nation) GROUP BY ALL""")(
    lambda s, d: V.table(s, d, "nation").select("n_nationkey", F.explode(A.merged(
        F.create_map(F.lit("A"), F.col("n_name"), F.lit("B"), F.lit("old")), F.create_map(F.lit("B"), F.col("n_regionkey").cast("string"), F.lit("C"), F.col("n_nationkey").cast("string")))).alias("k", "v"))
)
query("solve_summary", O.query(_NUMBERS, select=f"""SELECT p_partkey, array_to_string(list_filter([
  printf('RA:          %s  (%.6f deg)', {_HMS.format('ra')}, ra), printf('Dec:         %s  (%.6f deg)', {_DMS.format('dec')}, dec), printf('Orientation: %.2f deg (E of N)', ra),
  printf('Field size:  %.2f%s x %.2f%s', p_size * 1.5e0, chr(39), p_size::DOUBLE, chr(39)), printf('Pixel scale: %.3f arcsec/px', (p_retailprice + 3e-3) / 1000), 'Parity:      ' || CASE WHEN dec < 0 THEN 'Flipped' ELSE 'Normal' END,
  CASE WHEN p_size % 2 = 0 THEN 'Objects:     ' || array_to_string(list_transform(range(least(p_size % 13, 10)), lambda i: p_name || i), ', ') END,
  CASE WHEN p_size % 3 = 0 THEN 'WCS:         Available (2 keywords)' END], lambda x: x IS NOT NULL AND x <> 'Objects:     '), chr(10)) AS text FROM n JOIN part USING (p_partkey)"""))(
    lambda s, d: _numbers(s, d).join(V.table(s, d, "part"), "p_partkey").select("p_partkey", A.summary(
        F.col("ra"), F.col("dec"), F.col("ra"), F.col("p_size") * 1.5, F.col("p_size").cast("double"), (F.col("p_retailprice") + 0.003) / 1000, F.when(F.col("dec") < 0, "Flipped").otherwise("Normal"),
        F.when((F.col("p_size") % 2 == 0) & (F.col("p_size") % 13 > 0), F.transform(F.sequence(F.lit(0), F.greatest(F.col("p_size") % 13 - 1, F.lit(0))), lambda i: F.concat("p_name", i.cast("string")))),
        F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2")))).alias("text"))
)

# Star profiles, denoising, registration: numerical kernels.

_MOMENT = """cut AS (SELECT s.frame_id, s.y AS sy, s.x AS sx, p.y - s.y AS dy, p.x - s.x AS dx, p.v - min(p.v) OVER (PARTITION BY s.frame_id, s.y, s.x) AS f
  FROM pk s JOIN (SELECT frame_id, y, x, v FROM mono) p ON p.frame_id = s.frame_id AND p.y BETWEEN s.y - 5 AND s.y + 5 AND p.x BETWEEN s.x - 5 AND s.x + 5),
mom AS (SELECT frame_id, sy, sx, sum(f) AS flux, sum(f*dx*dx)/sum(f) AS xx, sum(f*dy*dy)/sum(f) AS yy, sum(f*dx*dy)/sum(f) AS xy FROM cut GROUP BY ALL)"""
query("moment_psf", O.query(O.MONO, "pk AS MATERIALIZED (" + O.maxima("mono", "p", 5, 64).split("AS MATERIALIZED (", 1)[1][:-1] + " AND v > 0.2)", _MOMENT, select="""SELECT 0 AS stack_id, frame_id, sy AS y, sx AS x, round(flux, 6) AS flux,
  round(sqrt((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy)) * 2.3548, 6) AS major, round(sqrt(greatest((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 0)) * 2.3548, 6) AS minor FROM mom"""))(
    lambda s, d: psf.moment_psf(_mono(s, d).drop("c"), N.local_maxima(_mono(s, d).drop("c"), SYNTH_SIZE, 5, 0.2).select("stack_id", "frame_id", "y", "x"))
)
query("psf_fit")(lambda s, d: psf.fit_stars(_mono(s, d).drop("c"), SYNTH_SIZE))
query("frame_psf")(lambda s, d: psf.frame_psf(_mono(s, d).drop("c"), SYNTH_SIZE))
# Non-local means by shifts: squared differences of the mirrored image, box sums by two windows, weighted means of the shifted.
_NLM = """mad_ AS (SELECT stack_id, frame_id, c, 1.4826 * mad(v) * {k} AS h FROM mono GROUP BY ALL),
mirror AS (SELECT i, CASE WHEN i < 0 THEN -1 - i WHEN i > 63 THEN 127 - i ELSE i END AS j FROM range(-8, 72) t(i)),
wide AS MATERIALIZED (SELECT stack_id, frame_id, c, a.i::INT AS y, b.i::INT AS x, v FROM mono JOIN mirror a ON a.j = y JOIN mirror b ON b.j = x),
diff AS MATERIALIZED (SELECT w.stack_id, w.frame_id, w.c, w.y, w.x, dy, dx, pow(w.v - o.v, 2) AS d, o.v AS other
  FROM wide w, range(-6, 7) p(dy), range(-6, 7) q(dx), wide o WHERE w.y BETWEEN -2 AND 65 AND w.x BETWEEN -2 AND 65 AND o.y = w.y + dy AND o.x = w.x + dx AND o.c = w.c AND o.frame_id = w.frame_id AND o.stack_id = w.stack_id),
box AS (SELECT *, sum(s) OVER (PARTITION BY stack_id, frame_id, c, dy, dx, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM (
  SELECT *, sum(d) OVER (PARTITION BY stack_id, frame_id, c, dy, dx, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM diff)),
weighed AS (SELECT stack_id, frame_id, c, y, x, other, exp(-t / (25 * h * h)) AS w FROM box JOIN mad_ USING (stack_id, frame_id, c) WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63)"""
for _name, _k in P.DENOISE.items():
    query(f"nlm_{_name}", O.query(O.MONO, _NLM.format(k=_k), select=f"SELECT {IMG}, y, x, round(sum(w * other) / sum(w), 6) AS v FROM weighed GROUP BY ALL"))(lambda s, d, k=_name: P.denoise(_mono(s, d), k, tile=32))


# A shift by whole pixels is undone: each frame has the first one's values where both reach.
@query("align_frames", O.query(O.SYNTH, """first AS (SELECT y, x, c, v FROM px WHERE frame_id = 0)""", select="""SELECT 0 AS stack_id, f AS frame_id, c, count(v) AS n, round(sum(v), 3) AS v FROM (
  SELECT s_suppkey::INT AS f FROM supplier) JOIN first ON y + f * 3 % 4 < 64 AND x - f * 5 % 4 >= 0 GROUP BY ALL"""))
def _aligned(s: SparkSession, d: str) -> DataFrame:
    out = registration.align_frames(V.synth_shifted(s, d), SYNTH_SIZE)[0]
    return out.groupBy("stack_id", "frame_id", "c").agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("v"))


# Two stacks of different stars whose frames have the same ids: each is matched to its own first frame.
@query("align_stacks", O.query(O.SYNTH.replace("SELECT 0 AS f", "SELECT unnest([0, 17]) AS f"), select="""SELECT s AS stack_id, f AS frame_id, c, count(v) AS n, round(sum(v), 3) AS v FROM (
  SELECT (s_suppkey % 2)::INT AS s, (s_suppkey // 2)::INT AS f FROM supplier) k JOIN px ON px.frame_id = 17 * s AND y + f * 3 % 4 < 64 AND x - f * 5 % 4 >= 0 GROUP BY ALL"""))
def _aligned_stacks(s: SparkSession, d: str) -> DataFrame:
    out = registration.align_frames(V.synth_stacks(s, d), SYNTH_SIZE)[0]
    return out.groupBy("stack_id", "frame_id", "c").agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("v"))


# The same kernels over many frames, one for each supplier, summed up by frame: their work grows with the table.

_sums = lambda df: df.groupBy("stack_id", "frame_id").agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("v"))
query("frames_sources", O.query(O.MONO_FRAMES, _DETECT, O.blur("flat", "b", "2.5", 64, "stack_id, frame_id"), O.maxima("b", "p", 5, 64), select="""SELECT stack_id, frame_id, count(f.v) AS n, round(sum(f.v), 3) AS v
  FROM p JOIN flat f USING (stack_id, frame_id, y, x) JOIN (SELECT frame_id, greatest(median(v) + 0.9 * stddev_pop(v), 0.01) AS t FROM b GROUP BY 1) USING (frame_id) WHERE p.v > t GROUP BY ALL"""))(
    lambda s, d: _sums(N.detect_sources(V.synth_px(s, d).filter("c = 0").drop("c"), SYNTH_SIZE))
)
query("frames_median3x3", O.query(O.MONO_FRAMES, select="""SELECT stack_id, frame_id, count(v) AS n, round(sum(v), 3) AS v FROM (
  SELECT stack_id, frame_id, oy, ox, median(v) AS v FROM (
    SELECT oy, ox, least(greatest(oy + dy, 0), 63) AS y, least(greatest(ox + dx, 0), 63) AS x FROM range(64) a(oy), range(64) b(ox), range(-1, 2) e(dy), range(-1, 2) f(dx))
  JOIN mono USING (y, x) GROUP BY ALL) GROUP BY ALL"""))(lambda s, d: _sums(N.median_3x3(V.synth_px(s, d).filter("c = 0"), SYNTH_SIZE)))
query("frames_star_reduce", O.query(O.SYNTH_FRAMES, _STARS, select=f"""SELECT stack_id, frame_id, count(v) AS n, round(sum(greatest(v - 0.5 * m * greatest(v - (n * (1 - m) + f * m), 0), 0)), 3) AS v FROM (
  SELECT {IMG}, y, x, px.v, nb.v AS n, fb.v AS f, least(greatest(mk.v * 2 * pi() * 10.5 * 10.5, 0), 1) AS m
  FROM px JOIN nb USING ({IMG}, y, x) JOIN fb USING ({IMG}, y, x) JOIN mk USING (stack_id, frame_id, y, x)) GROUP BY ALL"""))(lambda s, d: _sums(P.reduce_stars(V.synth_px(s, d), SYNTH_SIZE, 0.5)))
query("frames_denoise")(lambda s, d: _sums(P.denoise(V.synth_px(s, d).filter("c = 0"), "medium", tile=64, size=SYNTH_SIZE)))
