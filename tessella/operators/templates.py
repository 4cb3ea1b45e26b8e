"""Template classifiers of glyphs and the weighted ensemble of models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import kernels

# Kind, most templates a class, temperature, and weight in the ensemble.
PIXEL = ("pixel", 120, 0.035, 0.20)
ZONING = ("zoning", 60, 0.08, 0.05)
SAMPLE = ("sample", 120, 0.035, 0.05)
NETWORK_WEIGHT = 0.70
ZONES = (8, 8)


def vector(glyph: np.ndarray, kind: str) -> np.ndarray:
    """Levels from 0 to 1, or the share of foreground in each of 8 x 8 zones."""
    return kernels.zoning(glyph, ZONES) if kind == "zoning" else glyph.ravel() / 255.0


def scores(x: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(x - x.min(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Templates:
    """Softmax over minus the least mean squared difference to a class's templates."""

    kind: str
    temperature: float
    vectors: np.ndarray
    labels: np.ndarray
    classes: list[str] = field(init=False)

    def __post_init__(self):
        if self.temperature <= 0:
            raise ValueError("the temperature must be positive")
        if not len(self.labels) or len(self.labels) != len(self.vectors):
            raise ValueError("as many labels as templates are needed, one at least")
        self.classes = sorted(set(map(str, self.labels)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(n, classes), one class after another, so that no array holds all pairs of cells."""
        norm = (x**2).mean(axis=1)[:, None]
        out = []
        for c in self.classes:
            own = self.vectors[self.labels == c]
            out.append((norm + (own**2).mean(axis=1)[None, :] - 2 * (x @ own.T) / x.shape[1]).min(axis=1))
        return np.stack(out, axis=1)

    def proba(self, glyphs: list[np.ndarray]) -> np.ndarray:
        return scores(self.distances(np.stack([vector(g, self.kind) for g in glyphs])), self.temperature)


def train(glyphs: DataFrame, kind: str, most: int, temperature: float, seed: int = 42) -> Templates:
    """At most `most` glyphs of each class, by a hash of seed and id, are kept as templates; with
    `most` 0 a class has one, its mean. What reaches the driver is bounded by classes x most."""
    if most < 0:
        raise ValueError("the number of templates may not be negative")

    def run(batches):
        for pdf in batches:
            pdf["vec"] = [vector(np.frombuffer(d, np.uint8).reshape(h, w), kind).tolist() for d, h, w in zip(pdf["data"], pdf["h"], pdf["w"], strict=True)]
            yield pdf[["label", "vec"]]

    if most:
        order = Window.partitionBy("label").orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id")
        kept = glyphs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).orderBy("label", "r")
        rows = kept.select("label", "h", "w", "data").mapInPandas(run, "label string, vec array<double>").collect()
    else:
        cells = glyphs.select("label", "h", "w", "data").mapInPandas(run, "label string, vec array<double>").select("label", F.posexplode("vec").alias("i", "v"))
        means = cells.groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
        rows = means.select("label", F.transform("c", lambda c: c["v"]).alias("vec")).orderBy("label").collect()
    return Templates(kind, temperature, np.array([r.vec for r in rows]), np.array([r.label for r in rows]))


def ensemble(outputs: list[tuple[list[str], np.ndarray, float]]) -> tuple[list[str], np.ndarray]:
    """(classes, p) of a weighted mean over the union of classes; one a model lacks counts 0."""
    classes = sorted({c for names, _, _ in outputs for c in names})
    p = sum((w * q) @ np.array([[float(c == k) for k in classes] for c in names]) for names, q, w in outputs)
    return classes, p / np.maximum(p.sum(axis=1, keepdims=True), 1e-8)
