"""Scalars of astrometry: angles as text, plate scale, headers, annotations."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import let

#: Images are enlarged by this before they are solved; header keys that a solution does not carry over.
SOLVE_ZOOM = 1.2
STRUCTURAL = ["SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "EXTEND", "HISTORY", "COMMENT", "", "IMAGEW", "IMAGEH"]
KINDS = ["ic", "ngc", "hd", "bright_star", "messier", "other"]


def ra_hms(degrees: Column) -> Column:
    """``HHh MMm SS.SSs``; hours and minutes are cut off, the seconds rounded."""
    hours = degrees / 15.0
    h = F.floor(hours).cast("int")
    m = F.floor((hours - h) * 60).cast("int")
    return F.format_string("%02dh %02dm %05.2fs", h, m, (hours - h - m / 60.0) * 3600)


def dec_dms(degrees: Column) -> Column:
    """``+DDd MM' SS.S"``."""
    a = F.abs(degrees)
    d = F.floor(a).cast("int")
    m = F.floor((a - d) * 60).cast("int")
    return F.format_string("%s%02dd %02d' %04.1f\"", F.when(degrees >= 0, "+").otherwise("-"), d, m, (a - d - m / 60.0) * 3600)


def plate_scale(micron: Column, focal_mm: Column, spread: float = 0.25) -> Column:
    """Struct ``scale, low, high`` in arc seconds a pixel; NULL for a focal length up to 1 mm or pixels up to 0.01 micron."""
    scale = F.try_divide(micron, focal_mm) * 206.265
    return F.when((focal_mm > 1) & (micron > 0.01), F.struct(scale.alias("scale"), F.round(scale * (1 - spread), 3).alias("low"), F.round(scale * (1 + spread), 3).alias("high")))


def scale_hint(value: Column, unit: Column, drizzled: Column) -> Column:
    """A hint for the enlarged image: arc seconds a pixel shrink by the zoom, any hint halves when drizzled."""
    return value / F.when(unit == "arcsecperpix", SOLVE_ZOOM).otherwise(1.0) / F.when(drizzled, 2.0).otherwise(1.0)


def _number(x: Column) -> Column:
    return F.struct(x.cast("double").alias("number"), F.lit(None).cast("string").alias("text"))


def _text(x: Column | str) -> Column:
    return F.struct(F.lit(None).cast("double").alias("number"), (x if isinstance(x, Column) else F.lit(x)).alias("text"))


def _map(parts: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])


def solution_header(ra: Column, dec: Column, orientation: Column, field_w: Column, field_h: Column, pixel_scale: Column, flipped: Column, wcs: Column, width: Column, height: Column) -> Column:
    """All keywords of a plate solution for the image before it was enlarged: a map of ``struct<number, text>``.

    ``wcs`` is the solver's own header (a map of text) or NULL; ``width`` and ``height`` are those of the image, 0 if
    not known; fields are in arc minutes, the scale in arc seconds a pixel of the enlarged image.  Of the solver's
    header structural keys are left out, the reference pixel and scales are brought to the original image, and CDELT
    goes where there is a CD matrix; its other keys win over the general ones.  Without it the CD matrix follows from
    scale, position angle and parity, and the reference pixel is the centre: of the image, of the field, or of 4000 x 3000.
    """
    original = pixel_scale * SOLVE_ZOOM
    general = _map({
        "CTYPE1": _text("RA---TAN"), "CTYPE2": _text("DEC--TAN"), "EQUINOX": _number(F.lit(2000.0)), "RADESYS": _text("ICRS"), "CRVAL1": _number(ra), "CRVAL2": _number(dec),
        "OBJCTRA": _text(ra_hms(ra)), "OBJCTDEC": _text(dec_dms(dec)), "RA": _number(ra), "DEC": _number(dec), "PLTSOLVD": _text("T"),
        "FLDWIDTH": _number(field_w), "FLDHGHT": _number(field_h), "PIXSCALE": _number(original), "PA": _number(orientation),
    })
    own = lambda w: let(F.map_contains_key(w, F.lit("CD1_1")), lambda has_cd: F.map_filter(w, lambda k, _: ~k.isin(*STRUCTURAL) & ~(k.isin("CDELT1", "CDELT2") & has_cd)))

    def value(k: Column, v: Column) -> Column:
        number = v.try_cast("double")
        scaled = F.when(k.isin("CRPIX1", "CRPIX2"), number / SOLVE_ZOOM).when(k.isin("CD1_1", "CD1_2", "CD2_1", "CD2_2", "CDELT1", "CDELT2"), number * SOLVE_ZOOM).otherwise(number)
        return F.when(number.isNull(), _text(v)).otherwise(_number(scaled))

    s, angle, flip = original / 3600.0, F.radians(orientation), F.when(flipped, -1.0).otherwise(1.0)
    field = (field_w > 0) & (original > 0)
    side = lambda known, wide, least: F.when((width > 0) & (height > 0), known).when(field, wide * 60.0 / original).otherwise(least)
    derived = _map({
        "CD1_1": _number(-s * F.cos(angle) * flip), "CD1_2": _number(s * F.sin(angle)), "CD2_1": _number(-s * F.sin(angle) * flip), "CD2_2": _number(-s * F.cos(angle)),
        "CRPIX1": _number(side(width, field_w, 4000.0) / 2.0), "CRPIX2": _number(side(height, field_h, 3000.0) / 2.0),
    })
    # A solver's header without any key counts as none.
    return merged(general, let(wcs, lambda w: F.when(F.size(w) > 0, F.transform_values(own(w), value)).otherwise(derived)))


def merged(header: Column, over: Column) -> Column:
    """A header with the keys of another over its own; the other is made once, not again for each key."""
    return let(over, lambda o: F.map_concat(F.map_filter(header, lambda k, _: ~F.map_contains_key(o, k)), o))


def annotation_class(name: Column, kind: Column) -> Column:
    """``messier`` by name (``m`` and a blank, or ``m`` and nothing but a number), else a known kind, else ``other``."""
    low = F.lower(name)
    return F.when(low.startswith("m ") | low.rlike(r"^m\s*[0-9]+\s*$"), "messier").when(F.lower(kind).isin(*KINDS), F.lower(kind)).otherwise("other")


def annotations(json: Column) -> Column:
    """Objects of a solve result: the first name, else the type, else Unknown; missing numbers as 0, 0 and 30."""
    rows = F.from_json(json, "array<struct<names:array<string>,type:string,pixelx:double,pixely:double,radius:double>>")
    return F.transform(rows, lambda o: F.struct(
        F.coalesce(F.get(o["names"], 0), o["type"], F.lit("Unknown")).alias("name"), F.coalesce(o["pixelx"], F.lit(0.0)).alias("pixel_x"),
        F.coalesce(o["pixely"], F.lit(0.0)).alias("pixel_y"), F.coalesce(o["radius"], F.lit(30.0)).alias("radius"), F.coalesce(o["type"], F.lit("")).alias("type"),
    ))


def summary(ra: Column, dec: Column, orientation: Column, field_w: Column, field_h: Column, scale: Column, parity: Column, objects: Column, wcs: Column) -> Column:
    """The solution as a block of text; lines of objects (the first 10) and of the solver's header only where there are any."""
    lines = [
        F.format_string("RA:          %s  (%.6f deg)", ra_hms(ra), ra),
        F.format_string("Dec:         %s  (%.6f deg)", dec_dms(dec), dec),
        F.format_string("Orientation: %.2f deg (E of N)", orientation),
        F.format_string("Field size:  %.2f' x %.2f'", field_w, field_h),
        F.format_string("Pixel scale: %.3f arcsec/px", scale),
        F.concat(F.lit("Parity:      "), parity),
        F.when(F.size(objects) > 0, F.concat(F.lit("Objects:     "), F.array_join(F.slice(objects, 1, 10), ", "))),
        F.when(F.size(wcs) > 0, F.format_string("WCS:         Available (%d keywords)", F.size(wcs))),
    ]
    return F.concat_ws("\n", *lines)
