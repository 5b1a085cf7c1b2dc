"""Saved sessions: their 25 settings with defaults, their files, and the run they describe, from files to files."""

from __future__ import annotations

import json

from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration
from ..sources import images
from ..sources.stage import staged
from .pipeline import Config, run

#: The settings of a session and what each is where a session lacks it.
FIELDS: dict[str, object] = {
    "light_paths": [], "dark_paths": [], "flat_paths": [], "dark_flat_paths": [], "master_dark_path": "", "master_flat_path": "", "stacking_method": "sigma_clip", "sigma_low": 2.5,
    "sigma_high": 2.5, "percentile_low": 10.0, "percentile_high": 10.0, "camera_type": "mono", "bayer_pattern": "RGGB", "output_path": "stacked.fits", "reference_frame": 0,
    "auto_reject": False, "remove_gradient": False, "local_normalise": False, "denoise": False, "denoise_strength": "medium", "deconvolve": False, "deconv_strength": "medium",
    "auto_crop": False, "drizzle": False, "auto_solve": False,
}
ROLES = ["light_paths", "dark_paths", "flat_paths", "dark_flat_paths"]
_KINDS = {list: "array<string>", str: "string", float: "double", int: "int", bool: "boolean"}


def parse(text: Column) -> Column:
    """The settings of a session in JSON as a struct: missing, null or unreadable ones by default, unknown ones left out."""
    got = F.from_json(text, ", ".join(f"{k} {_KINDS[type(v)]}" for k, v in FIELDS.items()))
    plain = lambda v: F.array().cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.struct(*[F.coalesce(got[k], plain(v)).alias(k) for k, v in FIELDS.items()])


def present_files(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """``session_id, role, position, path`` for the listed files that are there: ``sessions`` has ``session_id`` and
    ``settings`` (of ``parse``), ``files`` has ``path``.  Files that have vanished are left out."""
    lists = F.array(*[F.struct(F.lit(r).alias("role"), F.col("settings")[r].alias("paths")) for r in ROLES])
    rows = sessions.select("session_id", F.inline(lists)).select("session_id", "role", F.posexplode("paths").alias("position", "path"))
    return rows.join(files.select("path").distinct(), "path", "left_semi").select("session_id", "role", "position", "path")


def load(text: str) -> dict[str, object]:
    """One session for the driver, as ``parse`` reads it but for its files, which are checked when it is run."""
    found = json.loads(text)
    return {k: found[k] if isinstance(found.get(k), (type(v), *([int] if isinstance(v, float) else []))) else v for k, v in FIELDS.items()}


def save(settings: dict[str, object]) -> str:
    return json.dumps({k: settings.get(k, v) for k, v in FIELDS.items()}, indent=2)


def config_of(settings: dict[str, object]) -> Config:
    low, high = ("percentile_low", "percentile_high") if settings["stacking_method"] == "percentile_clip" else ("sigma_low", "sigma_high")
    return Config(
        method=settings["stacking_method"], low=settings[low], high=settings[high], bayer=settings["bayer_pattern"] if settings["camera_type"] == "colour" else None,
        normalise=settings["local_normalise"], reject=settings["auto_reject"], align=True, reference=settings["reference_frame"], drizzle=settings["drizzle"], crop=settings["auto_crop"],
        gradient=settings["remove_gradient"], sharpen=settings["deconv_strength"] if settings["deconvolve"] else None, denoise=settings["denoise_strength"] if settings["denoise"] else None,
    )


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def frames_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pixels of a list of files, ``stack_id, frame_id, y, x, c, v``: the frame is the place in the list."""
    names = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "frame_id int, name string")
    px = images.load_images(spark, paths).join(F.broadcast(names), _bare(F.col("path")) == _bare(F.col("name")))  # as long as the list
    return px.select(F.lit(0).alias("stack_id"), "frame_id", "y", "x", "c", "v")


def run_session(spark: SparkSession, settings: dict[str, object], align: bool = True) -> str:
    """Run a session from its files and return the path of the finished image.

    Masters are read where the session names them, else built from its frames and saved as ``master_dark.fits`` and
    ``master_flat.fits`` beside the output.  A relative output path is beside the first light.
    """
    there = lambda p: stores.FileSystem.from_uri(p)[0].get_file_info(stores.FileSystem.from_uri(p)[1]).is_file if "://" in p else stores.LocalFileSystem().get_file_info(p).is_file
    lists = {r: [p for p in settings[r] if there(p)] for r in ROLES}
    if not lists["light_paths"]:
        raise ValueError("a session takes at least one light frame that is there")
    out = settings["output_path"]
    if "://" not in out and not out.startswith("/"):
        out = f"{lists['light_paths'][0].rpartition('/')[0]}/{out}"
    folder = out.rpartition("/")[0]

    def master(path: str, name: str, make: object) -> DataFrame | None:
        if path:
            return images.load_image(spark, path).select("y", "x", "c", "v")
        made = make()
        if made is None:
            return None
        made = staged(made, name)
        images.save_image(made, f"{folder}/{name}.fits")
        return made

    frames = {r: frames_of(spark, p) if p else None for r, p in lists.items()}
    dark = master(settings["master_dark_path"], "master_dark", lambda: None if frames["dark_paths"] is None else calibration.combine(frames["dark_paths"], "median"))
    flat = master(settings["master_flat_path"], "master_flat", lambda: None if frames["flat_paths"] is None else calibration.master_flat(frames["flat_paths"], frames["dark_flat_paths"], "median"))
    lights = staged(frames["light_paths"], "lights")
    ends = lights.agg(F.max("y"), F.max("x")).first()
    config = config_of(settings)
    config.align = align and len(lists["light_paths"]) > 1
    image = staged(run(lights, (ends[0] + 1, ends[1] + 1), config, dark, flat), "finished")
    images.save_image(image, out)
    return out
