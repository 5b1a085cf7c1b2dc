"""Mosaics: panels with a sky position each, put on one grid and blended by feathered weights.

``panels`` has ``panel_id, width, height, crpix, crval, cd`` (arrays of doubles) and may have ``sip_a, sip_b`` (arrays of
structs ``p, q, k``: distortion polynomials, null or empty without), ``px`` has ``panel_id, y, x, c, v``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

BORDER, MOST_SIDE, MARGIN = 30, 20_000, 1.05
#: Side of the output tiles in which panels are resampled.
TILE = 128
SIP = "array<struct<p:int,q:int,k:double>>"


def feather(y: Column, x: Column, height: Column, width: Column, border: int = BORDER) -> Column:
    """Weight of a pixel: distance to the nearest edge over ``border``, at most 1."""
    return F.least((y + 1) / border, (height - y) / border, (x + 1) / border, (width - x) / border, F.lit(1.0))


def add_sky(df: DataFrame, x: Column, y: Column, prefix: str = "", names: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """``df`` with right ascension and declination (degrees) of a 0-based pixel by the gnomonic projection of the columns
    ``crpix, crval, cd`` with that prefix.  Steps are columns of their own, so that none is computed twice."""
    pix, val, cd = (F.col(prefix + n) for n in ("crpix", "crval", "cd"))
    out = df.withColumns({"_dx": x + 1 - pix[0], "_dy": y + 1 - pix[1], "_d0": F.radians(val[1])})
    if prefix + "sip_a" in df.columns:
        off = lambda n: F.coalesce(F.aggregate(n, F.lit(0.0), lambda t, e: t + e["k"] * F.pow("_dx", e["p"]) * F.pow("_dy", e["q"])), F.lit(0.0))
        out = out.withColumn("_offx", off(F.col(prefix + "sip_a"))).withColumn("_offy", off(F.col(prefix + "sip_b")))  # both before either place moves
        out = out.withColumn("_dx", F.col("_dx") + F.col("_offx")).withColumn("_dy", F.col("_dy") + F.col("_offy")).drop("_offx", "_offy")
    out = out.withColumns({"_xi": F.radians(F.col("_dx") * cd[0] + F.col("_dy") * cd[1]), "_eta": F.radians(F.col("_dx") * cd[2] + F.col("_dy") * cd[3])})
    out = out.withColumn("_below", F.cos("_d0") - F.col("_eta") * F.sin("_d0"))
    ra = F.pmod(val[0] + F.degrees(F.atan2("_xi", "_below")), F.lit(360.0))
    dec = F.degrees(F.atan2(F.sin("_d0") + F.col("_eta") * F.cos("_d0"), F.sqrt(F.col("_xi") * F.col("_xi") + F.col("_below") * F.col("_below"))))
    return out.withColumns({names[0]: ra, names[1]: dec}).drop("_dx", "_dy", "_d0", "_xi", "_eta", "_below")


def add_pixel(df: DataFrame, ra: str, dec: str, prefix: str = "", names: tuple[str, str] = ("px", "py")) -> DataFrame:
    """``df`` with the 0-based pixel of a sky position, by the inverse of the CD matrix."""
    pix, val, cd = (F.col(prefix + n) for n in ("crpix", "crval", "cd"))
    out = df.withColumns({"_a": F.radians(F.col(ra) - val[0]), "_d": F.radians(dec), "_d0": F.radians(val[1])})
    out = out.withColumn("_below", F.sin("_d") * F.sin("_d0") + F.cos("_d") * F.cos("_d0") * F.cos("_a"))
    eta = (F.sin("_d") * F.cos("_d0") - F.cos("_d") * F.sin("_d0") * F.cos("_a")) / F.col("_below")
    out = out.withColumns({"_xi": F.degrees(F.cos("_d") * F.sin("_a") / F.col("_below")), "_eta": F.degrees(eta), "_det": cd[0] * cd[3] - cd[1] * cd[2]})
    x, y = (F.col("_xi") * cd[3] - F.col("_eta") * cd[1]) / F.col("_det") + pix[0] - 1, (F.col("_eta") * cd[0] - F.col("_xi") * cd[2]) / F.col("_det") + pix[1] - 1
    return out.withColumns({names[0]: x, names[1]: y}).drop("_a", "_d", "_d0", "_below", "_xi", "_eta", "_det")


def _points(steps: int) -> Column:
    """Places on a panel, from corner to corner, ``steps`` a side, as rows ``x, y``."""
    at = lambda i, side: (F.col(side) - 1) * (i / (steps - 1))
    return F.inline(F.array(*[F.struct(at(i, "width").alias("x"), at(j, "height").alias("y")) for i in range(steps) for j in range(steps)]))


def output_grid(panels: DataFrame) -> DataFrame:
    """One row ``o_width, o_height, o_crpix, o_crval, o_cd``: a grid of the finest panel's scale over all panels.

    Right ascensions that span over 180 degrees are taken around 0.  A side above 20000 pixels is scaled down.
    """
    sky = add_sky(panels.select("*", _points(2)), F.col("x"), F.col("y")).select("ra", "dec")
    shifted = F.when(F.col("ra") > 180, F.col("ra") - 360).otherwise(F.col("ra"))
    ends = sky.agg(F.min("ra").alias("a0"), F.max("ra").alias("a1"), F.min(shifted).alias("b0"), F.max(shifted).alias("b1"), F.min("dec").alias("d0"), F.max("dec").alias("d1"))
    around = F.col("a1") - F.col("a0") > 180
    ends = ends.select(F.when(around, F.col("b0")).otherwise(F.col("a0")).alias("r0"), F.when(around, F.col("b1")).otherwise(F.col("a1")).alias("r1"), "d0", "d1")
    both = add_sky(add_sky(panels, F.col("width") / 2, F.col("height") / 2), F.col("width") / 2 + 1, F.col("height") / 2, names=("ra2", "dec2"))
    step = F.sqrt(F.pow((F.col("ra2") - F.col("ra")) * F.cos(F.radians("dec")), F.lit(2)) + F.pow(F.col("dec2") - F.col("dec"), F.lit(2)))
    finest = both.agg(F.min(step).alias("s"), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n") >= 2, F.col("s")).otherwise(F.raise_error(F.lit("a mosaic takes at least 2 panels")).cast("double"))
    out = ends.crossJoin(finest).withColumn("s", checked)
    wide = F.floor((F.col("r1") - F.col("r0")) * MARGIN * F.cos(F.radians((F.col("d0") + F.col("d1")) / 2)) / F.col("s")) + 1
    high = F.floor((F.col("d1") - F.col("d0")) * MARGIN / F.col("s")) + 1
    out = out.withColumns({"w": wide.cast("int"), "h": high.cast("int")}).withColumn("k", F.greatest(F.greatest("w", "h") / MOST_SIDE, F.lit(1.0)))
    out = out.select("r0", "r1", "d0", "d1", (F.col("s") * F.col("k")).alias("s"), F.floor(F.col("w") / F.col("k")).cast("int").alias("o_width"), F.floor(F.col("h") / F.col("k")).cast("int").alias("o_height"))
    centre = F.array((F.col("r0") + F.col("r1")) / 2, (F.col("d0") + F.col("d1")) / 2)
    return out.select("o_width", "o_height", F.array(F.col("o_width") / 2, F.col("o_height") / 2).alias("o_crpix"), centre.alias("o_crval"), F.array(-F.col("s"), F.lit(0.0), F.lit(0.0), F.col("s")).alias("o_cd"))


def distortion(terms: list[dict], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A polynomial of ``p, q, k`` at places relative to the reference pixel."""
    out = np.zeros(np.shape(u))
    for t in terms or ():
        out += t["k"] * u ** t["p"] * v ** t["q"]
    return out


def undistorted(a: list[dict], b: list[dict], u: np.ndarray, v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The places that the polynomials ``a, b`` move to ``u, v``, by fixed-point steps."""
    x, y = u, v
    for _ in range(rounds if a or b else 0):
        nx, ny = u - distortion(a, x, y), v - distortion(b, x, y)
        still = max(np.abs(nx - x).max(initial=0), np.abs(ny - y).max(initial=0)) < 1e-9
        x, y = nx, ny
        if still:
            break
    return x, y


def panel_places(panel: dict, grid: dict, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where output pixels lie on a panel (x, y from 0): to the sky by the grid, then back by the panel's solution."""
    (px, py), (r0, d0), (a, b, e, f) = grid["o_crpix"], np.radians(grid["o_crval"]), grid["o_cd"]
    dx, dy = x + 1 - px, y + 1 - py
    xi, eta = np.radians(dx * a + dy * b), np.radians(dx * e + dy * f)
    below = np.cos(d0) - eta * np.sin(d0)
    ra, dec = r0 + np.arctan2(xi, below), np.arctan2(np.sin(d0) + eta * np.cos(d0), np.hypot(xi, below))
    (px, py), (r0, d0), (a, b, e, f) = panel["crpix"], np.radians(panel["crval"]), panel["cd"]
    below = np.sin(dec) * np.sin(d0) + np.cos(dec) * np.cos(d0) * np.cos(ra - r0)
    below = np.where(below > 1e-9, below, np.nan)  # the far side of the sky
    xi = np.degrees(np.cos(dec) * np.sin(ra - r0) / below)
    eta = np.degrees((np.sin(dec) * np.cos(d0) - np.cos(dec) * np.sin(d0) * np.cos(ra - r0)) / below)
    u, v = (xi * f - eta * b) / (a * f - b * e), (eta * a - xi * e) / (a * f - b * e)
    u, v = undistorted(panel.get("sip_a"), panel.get("sip_b"), u, v)
    return u + px - 1, v + py - 1


def resampled(panel: dict, places: tuple[np.ndarray, np.ndarray], at: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bilinear values and weights at ``places`` (x, y) from the pixels ``at`` (y, x) of a panel, and which places have any."""
    ix, iy = places
    h, w = panel["height"], panel["width"]
    y0, x0 = at[0].min(), at[1].min()
    there = np.zeros((at[0].max() - y0 + 3, at[1].max() - x0 + 3), bool)  # an edge that is never there
    image = np.full(there.shape, np.nan)
    there[at[0] - y0, at[1] - x0], image[at[0] - y0, at[1] - x0] = True, values
    inside = (ix >= 0) & (ix < w - 1) & (iy >= 0) & (iy < h - 1)
    lx, ly = np.where(inside, np.floor(ix), 0).astype(int), np.where(inside, np.floor(iy), 0).astype(int)
    fx, fy = ix - lx, iy - ly
    v, weight, seen, valid = (np.zeros(len(ix), kind) for kind in (float, float, bool, bool))
    for j in (0, 1):
        for i in (0, 1):
            y, x = ly + j, lx + i
            k = (fx if i else 1 - fx) * (fy if j else 1 - fy)
            held = inside & (y >= y0) & (x >= x0) & (y < y0 + there.shape[0]) & (x < x0 + there.shape[1])
            own = np.where(held, y - y0, 0), np.where(held, x - x0, 0)
            held &= there[own]
            good = held & np.isfinite(image[own])
            edge = np.minimum.reduce([(y + 1) / BORDER, (h - y) / BORDER, (x + 1) / BORDER, (w - x) / BORDER, np.ones(len(y))])
            v += np.where(good, k * np.where(good, image[own], 0.0), 0.0)
            weight += np.where(held, k * edge, 0.0)
            seen |= held
            valid |= good
    return np.where(valid, v, np.nan), weight, seen


def reproject(px: DataFrame, panels: DataFrame, grid: DataFrame, tile: int = TILE) -> DataFrame:
    """``panel_id, y, x, c, v, w``: panels on the output grid, bilinear, with their weights.

    Each pixel of a panel goes to the output tiles that it may bear on, by its place on the sky, so a task resamples
    tiles of bounded size with the surroundings they need, and a large panel is as many tasks as it covers tiles.
    Pixels that the panel does not have are left out of value and weight.
    """
    both = panels.crossJoin(F.broadcast(grid))  # one row of grid
    cd, step = F.col("cd"), F.sqrt(F.abs(F.col("o_cd")[0] * F.col("o_cd")[3] - F.col("o_cd")[1] * F.col("o_cd")[2]))
    both = both.withColumn("reach", 2 + 2 * F.greatest(F.abs(cd[0]) + F.abs(cd[1]), F.abs(cd[2]) + F.abs(cd[3])) / step)
    sent = px.select("panel_id", "y", "x", "c", F.col("v").cast("double").alias("v")).join(both, "panel_id")
    sent = add_pixel(add_sky(sent, F.col("x"), F.col("y")), "ra", "dec", "o_", names=("ox", "oy"))
    low, high = (lambda a: F.floor((F.col(a) - F.col("reach")) / tile)), (lambda a: F.floor((F.col(a) + F.col("reach")) / tile))
    last = lambda n: F.floor((F.col(n) - 1) / tile)
    spread = lambda a, n: F.when((high(a) >= 0) & (low(a) <= last(n)), F.sequence(F.greatest(low(a), F.lit(0)), F.least(high(a), last(n))))
    # Outer, and the rest dropped after: a filter here, or one that is inferred, would repeat all of the place's arithmetic.
    sent = sent.withColumn("ty", F.explode_outer(spread("oy", "o_height"))).withColumn("tx", F.explode_outer(spread("ox", "o_width")))
    sent = sent.select("panel_id", "y", "x", "c", "v", "ty", "tx").filter(F.col("ty").isNotNull() & F.col("tx").isNotNull())
    lists = [F.collect_list(F.col(n).cast("int")).alias(f"{n}s") for n in "yx"] + [F.collect_list(F.coalesce("v", F.lit(float("nan")))).alias("vs")]
    tiles = sent.groupBy("panel_id", "c", "ty", "tx").agg(*lists).join(both.drop("reach"), "panel_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {n: one.column(n)[0].as_py() for n in one.schema.names if n not in ("ys", "xs", "vs")}
                at = tuple(np.asarray(one.column(n).flatten()) for n in ("ys", "xs"))
                values = one.column("vs").flatten().to_numpy(zero_copy_only=False)
                oy, ox = (a.ravel() for a in np.mgrid[row["ty"] * tile : min(row["o_height"], (row["ty"] + 1) * tile), row["tx"] * tile : min(row["o_width"], (row["tx"] + 1) * tile)])
                v, w, seen = resampled(row, panel_places(row, row, oy, ox), at, values)
                keys = [one.column(n).take(pa.array(np.zeros(int(seen.sum()), np.int64))) for n in ("panel_id", "c")]
                columns = [keys[0], pa.array(oy[seen], pa.int32()), pa.array(ox[seen], pa.int32()), keys[1], pa.array(v[seen], pa.float64(), from_pandas=True), pa.array(w[seen], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["panel_id", "y", "x", "c", "v", "w"])

    schema = StructType([panels.schema["panel_id"], StructField("y", IntegerType()), StructField("x", IntegerType()), px.schema["c"], StructField("v", DoubleType()), StructField("w", DoubleType())])
    return tiles.mapInArrow(run, schema)


def build_mosaic(px: DataFrame, panels: DataFrame) -> DataFrame:
    """``y, x, c, v``: the weighted mean of the panels where any reaches (elsewhere the mosaic is 0)."""
    rows = reproject(px, panels, output_grid(panels))
    return rows.groupBy("y", "x", "c").agg(F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("v"))


def panels_of(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``px`` and ``panels`` of plate-solved images (``path, header, y, x, c, v``, the header on one pixel of each).

    A panel is named by the rank of its path.  The scale is the CD matrix, else CDELT with PC or CROTA2.  A header
    without celestial axes is an error.
    """
    from pyspark.sql import Window

    heads = images.filter(F.col("header").isNotNull()).select("path", "header")
    heads = heads.withColumn("panel_id", F.row_number().over(Window.orderBy("path")) - 1)  # one row an image
    text = lambda k: F.upper(F.try_element_at("header", F.lit(k)))
    number = lambda k, least=0.0: F.coalesce(F.try_element_at("header", F.lit(k)).try_cast("double"), F.lit(least))
    celestial = text("CTYPE1").startswith("RA") & text("CTYPE2").startswith("DEC")
    error = F.raise_error(F.concat("path", F.lit(" has no valid celestial solution; solve this panel first"))).cast("boolean")
    turn = F.radians(number("CROTA2"))
    has = lambda *keys: sum((F.map_contains_key("header", F.lit(k)).cast("int") for k in keys), F.lit(0)) > 0
    cd = F.array(*[number(f"CD{i}_{j}") for i in (1, 2) for j in (1, 2)])
    pc = F.array(*[number(f"CDELT{i}", 1.0) * number(f"PC{i}_{j}", float(i == j)) for i in (1, 2) for j in (1, 2)])
    rotated = F.array(number("CDELT1", 1.0) * F.cos(turn), -number("CDELT2", 1.0) * F.sin(turn), number("CDELT1", 1.0) * F.sin(turn), number("CDELT2", 1.0) * F.cos(turn))
    order = lambda n: number(f"{n}_ORDER").cast("int")
    powers = [(p, q) for p in range(10) for q in range(10 - p)]
    term = lambda n, p, q: F.when((F.lit(p + q) <= order(n)) & F.map_contains_key("header", F.lit(f"{n}_{p}_{q}")), F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), number(f"{n}_{p}_{q}").alias("k")))
    sip = [F.when(text("CTYPE1").endswith("-SIP"), F.array_compact(F.array(*[term(n, p, q) for p, q in powers]))).cast(SIP).alias(f"sip_{n.lower()}") for n in "AB"]
    scale = F.when(has("CD1_1", "CD1_2", "CD2_1", "CD2_2"), cd).when(has("CROTA2"), rotated).otherwise(pc)
    panels = heads.filter(F.when(F.coalesce(celestial, F.lit(False)), True).otherwise(error)).select(
        "panel_id", number("NAXIS1").cast("int").alias("width"), number("NAXIS2").cast("int").alias("height"),
        F.array(number("CRPIX1"), number("CRPIX2")).alias("crpix"), F.array(number("CRVAL1"), number("CRVAL2")).alias("crval"), scale.alias("cd"), *sip)
    px = images.join(heads.select("path", "panel_id"), "path").select("panel_id", "y", "x", "c", "v")
    return px, panels


def grid_header() -> Column:
    """The header (a map of text) of a mosaic on the grid whose columns are there."""
    text = lambda x: x.cast("string")
    parts = {"WCSAXES": F.lit("2"), "CTYPE1": F.lit("RA---TAN"), "CTYPE2": F.lit("DEC--TAN"), "CUNIT1": F.lit("deg"), "CUNIT2": F.lit("deg")}
    for i in (1, 2):
        parts |= {f"CRPIX{i}": text(F.col("o_crpix")[i - 1]), f"CRVAL{i}": text(F.col("o_crval")[i - 1])}
        parts |= {f"CD{i}_{j}": text(F.col("o_cd")[2 * i + j - 3]) for j in (1, 2)}
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])


def mosaic_files(spark: SparkSession, paths: list[str] | str, output: str) -> None:
    """A mosaic of plate-solved FITS files, written with its own solution; 0 where no panel reaches."""
    from ..sources import fits
    from ..sources.stage import staged

    px, panels = panels_of(staged(fits.read_stored(spark, paths), "panel-pixels"))
    panels = staged(panels, "panels")
    grid = staged(output_grid(panels), "grid")
    image = build_mosaic(px, panels).crossJoin(F.broadcast(grid))  # one row of grid
    folder, _, name = output.rpartition("/")
    channels = staged(px.agg((F.max("c") + 1).alias("channels")), "channels")
    rows = image.crossJoin(F.broadcast(channels)).select(F.lit(name).alias("path"), grid_header().alias("header"), F.col("o_height").alias("height"), F.col("o_width").alias("width"), "channels", "y", "x", "c", "v")
    fits.save_images(rows, folder, fill=0.0)
