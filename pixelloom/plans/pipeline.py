"""The whole way from frames to a finished image, and its settings.

A stage reads its input more than once, so the result of each is written to the shared folder before the next plans on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import background, calibration, geometry, neighbours, postprocess, psf, quality, registration, stacking
from ..sources.stage import staged

FRAME = ["stack_id", "frame_id"]


@dataclass
class Config:
    """Settings; ``plans.session`` makes them of a saved session."""

    method: str = "median"
    low: float = 2.5
    high: float = 2.5
    bayer: str | None = None
    normalise: bool = False
    reject: bool = False
    align: bool = False
    reference: int = 0
    drizzle: bool = False
    scale: int = 2
    fraction: float = 0.7
    crop: bool = False
    gradient: bool = False
    balance: bool = False
    sharpen: str | None = None
    denoise: str | None = None
    star_reduction: float = 0.0


def run(lights: DataFrame, size: tuple[int, int], config: Config, dark: DataFrame | None = None, flat: DataFrame | None = None) -> DataFrame:
    """Calibrate, debayer, reject, normalise, align, stack, then ``postprocess``."""
    px = calibration.calibrate(lights, dark, flat) if dark is not None or flat is not None else lights
    if config.bayer:
        px = neighbours.debayer(px, size, config.bayer)
    px = staged(px, "calibrated")
    colour = px.agg(F.max("c")).first()[0] not in (None, 0)
    scores = None
    if config.reject or config.method == "weighted":
        mono = px.groupBy(*FRAME, "y", "x").agg(F.avg("v").alias("v"))
        scores = staged(quality.score_frames(staged(psf.frame_psf(mono, size), "psf")), "scores")
    if config.reject:
        px = quality.accepted(px, quality.guarded(scores))
    if config.normalise:
        px = staged(background.local_normalise(px, size, colour), "normalised")
    if config.align:
        px = staged(registration.align_frames(px, size, config.reference)[0], "aligned")
    if config.drizzle:
        image, size = stacking.drizzle(px, config.scale, config.fraction), (size[0] * config.scale, size[1] * config.scale)
    elif config.method == "weighted":
        image = stacking.stack(px, "weighted", weights=quality.psf_weights(scores))
    elif config.method in ("sigma_clip", "winsorised", "percentile_clip"):
        image = stacking.stack(px, config.method, low=config.low, high=config.high)
    else:
        image = stacking.stack(px, config.method)
    return postprocess_image(staged(image.withColumn("frame_id", F.lit(0)), "stacked"), size, config, colour)


def postprocess_image(image: DataFrame, size: tuple[int, int], config: Config, colour: bool = False, fwhm: float | None = None) -> DataFrame:
    """Gradient, colour balance, sharpening, denoising, star reduction, crop, each where asked for."""
    out = image
    if config.gradient:
        out = staged(background.remove_gradient(out, size, colour=colour), "processed")
    if config.balance and colour:
        out = staged(background.auto_balance(out, size), "processed")
    if config.sharpen:
        out = staged(postprocess.sharpen(out, size, fwhm or 2.5 * (config.scale if config.drizzle else 1), config.sharpen), "processed")
    if config.denoise:
        out = staged(postprocess.denoise(out, config.denoise), "processed")
    if config.star_reduction > 0:
        out = staged(postprocess.reduce_stars(out, size, config.star_reduction), "processed")
    if config.crop:
        out = geometry.auto_crop(out, colour)
    return out
