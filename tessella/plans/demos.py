"""Stage pictures of preprocessing and detection, as files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessella.config import Preprocess
from tessella.operators import kernels, packed, plates, reading
from tessella.sources import images

STAGE = "image_id long, stage string, h int, w int, channels int, data binary"


def _picture(stage: str, a: np.ndarray) -> dict:
    return {"stage": stage, "h": a.shape[0], "w": a.shape[1], "channels": 1 if a.ndim == 2 else 3, "data": np.ascontiguousarray(a).tobytes()}


def preprocess_stages(df: DataFrame, cfg: Preprocess = Preprocess()) -> DataFrame:
    """gray, blurred, enhanced, binary and all four side by side, for each image."""

    def make(_, gray):
        blurred = kernels.blur(gray, cfg.blur_size, cfg.blur_sigma)
        enhanced = kernels.clahe(blurred, cfg.grid, cfg.clip)
        binary = kernels.threshold(enhanced, kernels.otsu(enhanced), cfg.otsu_invert)
        stages = {"gray": gray, "blurred": blurred, "enhanced": enhanced, "binary": binary}
        return [_picture(f"preprocess_{k}", a) for k, a in stages.items()] + [_picture("preprocess_strip", images.side_by_side(list(stages.values())))]

    return packed.rows(df, STAGE, make)


def detection_stages(df: DataFrame) -> DataFrame:
    """The enhanced image and the same with the candidates' boxes."""

    def make(_, gray):
        enhanced = plates.enhance(gray)
        boxes = [(c["x"], c["y"], c["width"], c["height"]) for c in plates.detect(enhanced)]
        return [_picture("detection_enhanced", enhanced), _picture("detection_candidates", reading.draw_boxes(enhanced, boxes))]

    return packed.rows(df, STAGE, make)


def write_stages(stages: DataFrame, folder: str) -> DataFrame:
    """One PNG a stage; (image_id, path)."""
    named = stages.selectExpr("concat(image_id, '_', stage) image_id", "h", "w", "channels", "data")
    return images.write_images(named, folder)
