"""Kernels over packed rasters, one Arrow batch after another, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tessella.config import Detection
from tessella.operators import kernels as K
from tessella.operators import plates, segmentation

PACKED = "image_id long, h int, w int, data binary"
COMPONENT = "image_id long, label int, x int, y int, width int, height int, area long, cx double, cy double"
CANDIDATE = COMPONENT + ", aspect_ratio double, fill_ratio double, gradient_density double, score double"
GLYPH = "image_id long, char_idx int, row_index int, x int, y int, width int, height int, glyph binary"


def rows(df: DataFrame, schema: str, make: Callable[[int, np.ndarray], list[dict]]) -> DataFrame:
    """`make(image_id, raster)` gives the rows of one image."""
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for image_id, h, w, data in zip(pdf.image_id, pdf.h, pdf.w, pdf.data, strict=True):
                raster = np.frombuffer(data, np.uint8).reshape(h, w)
                out += [{"image_id": image_id, **r} for r in make(image_id, raster)]
            if out:
                yield pd.DataFrame(out)[names]

    return df.select("image_id", "h", "w", "data").mapInPandas(run, schema)


def filtered(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def make(_, a):
        out = kernel(a)
        return [{"h": out.shape[0], "w": out.shape[1], "data": np.ascontiguousarray(out, np.uint8).tobytes()}]

    return rows(df, PACKED, make)


def filtered_cells(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The kernel's result as LONG cells."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for image_id, h, w, data in zip(pdf.image_id, pdf.h, pdf.w, pdf.data, strict=True):
                out = kernel(np.frombuffer(data, np.uint8).reshape(h, w))
                y, x = np.indices(out.shape)
                yield pd.DataFrame({"image_id": image_id, "y": y.ravel(), "x": x.ravel(), "v": out.ravel().astype(int)})

    return df.select("image_id", "h", "w", "data").mapInPandas(run, "image_id long, y int, x int, v int")


def histogram(df: DataFrame) -> DataFrame:
    """(image_id, v, cnt): at most 256 rows an image, without a shuffle."""

    def make(_, a):
        count = np.bincount(a.ravel(), minlength=256)
        return [{"v": int(v), "cnt": int(count[v])} for v in np.flatnonzero(count)]

    return rows(df, "image_id long, v int, cnt long", make)


def components(df: DataFrame, connectivity: int = 8) -> DataFrame:
    return rows(df, COMPONENT, lambda _, a: K.stats(*K.label(a, connectivity)))


def preprocessed(a: np.ndarray) -> np.ndarray:
    """Step 1: the enhanced raster, dark cells lit."""
    enhanced = plates.enhance(a)
    return K.threshold(enhanced, K.otsu(enhanced), True)


def detect_in(enhanced: DataFrame, cfg: Detection) -> DataFrame:
    """Candidates of rasters that are enhanced already."""
    return rows(enhanced, CANDIDATE, lambda _, a: plates.detect(a, cfg))


def detect(df: DataFrame) -> DataFrame:
    return rows(df, CANDIDATE, lambda _, a: plates.detect(plates.enhance(a)))


def normalize(df: DataFrame) -> DataFrame:
    """The best candidate of each image as a packed 80 x 240 plate; no row without a candidate."""

    def make(_, a):
        enhanced = plates.enhance(a)
        for c in plates.detect(enhanced)[:1]:
            plate, _angle = plates.normalize(enhanced, (c["x"], c["y"], c["width"], c["height"]))
            return [{"h": plate.shape[0], "w": plate.shape[1], "data": plate.tobytes()}]
        return []

    return rows(df, PACKED, make)


def segment(df: DataFrame) -> DataFrame:
    def make(_, a):
        return [{**c, "glyph": c["glyph"].tobytes()} for c in segmentation.segment(a)]

    return rows(df, GLYPH, make)


def skew(df: DataFrame) -> DataFrame:
    return rows(df, "image_id long, angle double", lambda _, a: [{"angle": K.skew(a)}])


def feature_cells(df: DataFrame) -> DataFrame:
    """Gradient histograms, then zones, one row a feature; cells are half a small raster's height."""

    def make(_, a):
        found = np.concatenate([K.hog(a, min(8, a.shape[0] // 2)), K.zoning(a)])
        return [{"i": i, "value": float(v)} for i, v in enumerate(found)]

    return rows(df, "image_id long, i int, value double", make)


def read_plates(df: DataFrame) -> DataFrame:
    """Region choice per image: source, box, angle, number of characters and glyph features."""

    def make(_, a):
        enhanced = plates.enhance(a)
        found = plates.detect(enhanced)
        best = plates.choose_region(enhanced, found)
        return [{"candidates": len(found), "source": best["source"], "angle": best["angle"], "n_chars": len(best["chars"]), "features": [K.glyph_features(c["glyph"]).tolist() for c in best["chars"]]}]

    return rows(df, "image_id long, candidates int, source string, angle double, n_chars int, features array<array<float>>", make)


def first_candidate(df: DataFrame) -> DataFrame:
    """The library call: the best candidate alone, no region choice."""

    def make(_, a):
        enhanced = plates.enhance(a)
        found = plates.detect(enhanced)
        if not found:
            return [{"found": False, "angle": None, "n_chars": 0}]
        c = found[0]
        plate, angle = plates.normalize(enhanced, (c["x"], c["y"], c["width"], c["height"]))
        return [{"found": True, "angle": angle, "n_chars": len(segmentation.segment(plate))}]

    return rows(df, "image_id long, found boolean, angle double, n_chars int", make)
