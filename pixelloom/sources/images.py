"""Images by the suffix of their files: the FITS and XISF sources and sinks, and PNG export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fits, png, xisf

SUFFIXES = (*fits.SUFFIXES, *xisf.SUFFIXES)


def _format(path: str, what: str) -> object:
    name = path.lower()
    if name.endswith(fits.SUFFIXES):
        return fits
    if name.endswith(xisf.SUFFIXES):
        return xisf
    raise ValueError(f"unsupported {what}: {path!r}; supported: {', '.join(SUFFIXES)}")


def load_image(spark: SparkSession, path: str) -> DataFrame:
    """One image as ``path, header, y, x, c, v``; an unsupported suffix is an error, as is a file without an image."""
    return _format(path, "format").read_stored(spark, path)


def load_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Images of either format, as ``load_image`` gives them."""
    found = None
    for kind in (fits, xisf):
        if own := [p for p in paths if _format(p, "format") is kind]:
            rows = kind.read_stored(spark, own)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no image is named")
    return found


def save_image(px: DataFrame, path: str, header: Column | None = None) -> None:
    """Write one image (``y, x, c, v``) to ``path``, whose suffix names the format."""
    kind = _format(path, "output format")
    folder, _, name = path.rpartition("/")
    kind.save_images(px.select(F.lit(name).alias("path"), "y", "x", "c", "v", *([header.alias("header")] if header is not None else [])), folder or ".")


def export_picture(px: DataFrame, path: str, colour: bool = False) -> None:
    """The automatic stretch of one image (``y, x, c, v``) as an 8-bit PNG."""
    from ..functions.display import auto_stretch

    folder, _, name = path.rpartition("/")
    if not name.lower().endswith(".png"):
        raise ValueError(f"unsupported picture format: {name!r}; supported: .png")
    bytes_ = auto_stretch(px.select(F.lit(name).alias("path"), "y", "x", "c", "v"), ["path"], colour=colour)
    png.save_pictures(bytes_, folder or ".")


def collect_files(spark: SparkSession, path: str) -> DataFrame:
    """Supported files of a folder, one level deep, in order of their path."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.filter(F.lower("path").rlike(r"\.(fits|fit|fts|xisf)$")).orderBy("path")
