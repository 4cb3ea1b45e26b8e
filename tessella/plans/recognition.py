"""Whole plans: train a glyph network, read plates with it, evaluate readings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import kernels, packed, plates, reading
from tessella.operators.classify import Mlp
from tessella.operators.models import save_mlp, save_template_model
from tessella.operators.segmentation import segment
from tessella.operators.templates import NETWORK_WEIGHT, PIXEL, SAMPLE, ZONING, Templates, ensemble
from tessella.operators.templates import train as train_template_model
from tessella.sources import images

RESULT = (
    "image_id long, source string, candidates int, angle double, n_chars int, raw_text string, corrected_text string, "
    "formatted_text string, average_confidence double, low_confidence_indices array<int>, summary string"
)


def glyph_vectors(glyphs: DataFrame) -> DataFrame:
    """(sample_id, label, features): 324 gradient and 16 zone values of each 32 x 32 glyph."""

    def run(batches):
        for pdf in batches:
            pdf["features"] = [kernels.glyph_features(np.frombuffer(x, np.uint8).reshape(32, 32)).tolist() for x in pdf["data"]]
            yield pdf[["sample_id", "label", "features"]]

    return glyphs.select("sample_id", "label", "data").mapInPandas(run, "sample_id long, label string, features array<float>")


def train(glyphs: DataFrame, rows: int = 30_000, holdout: float = 0.2, seed: int = 42, **options) -> tuple[Mlp, float]:
    """A network on at most `rows` glyphs and its accuracy on the held-out share of them."""
    got = glyph_vectors(glyphs).orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(rows).collect()
    x, y = np.array([r.features for r in got]), [r.label for r in got]
    cut = max(1, int(len(got) * (1 - holdout)))
    model = Mlp(seed=seed, **options).fit(x[:cut], y[:cut])
    if cut == len(got):
        return model, float("nan")
    best = model.proba(x[cut:]).argmax(axis=1)
    return model, float(np.mean([model.classes[b] == t for b, t in zip(best, y[cut:], strict=True)]))


def default_model(spark: SparkSession, per_class: int = 30, epochs: int = 30) -> Mlp:
    made = images.synthetic_glyphs(spark, per_class=per_class)
    return train(made, holdout=0.0, hidden=(96,), epochs=epochs, rate=0.05)[0]


def probabilities(model, features: np.ndarray) -> np.ndarray:
    """What a classifier gives for feature rows: it has `classes`, and `proba` with a column for each."""
    if not callable(getattr(model, "proba", None)) or getattr(model, "classes", None) is None:
        raise ValueError("a classifier has proba() and classes")
    p = np.asarray(model.proba(features), float)
    if p.shape != (len(features), len(model.classes)):
        raise ValueError("proba() gives a row for each glyph and a column for each class")
    return p


def classify_glyphs(model, glyphs: list[np.ndarray], memories: tuple[Templates, ...] = ()) -> dict:
    """Labels, confidences and the three likeliest classes of each glyph.

    The network and the template models, as far as given, are blended by their fixed weights;
    doubtful letters are refined; a sample memory that is sure of every glyph has the last
    word. Confidences are those of the blend."""
    outputs = [] if model is None else [(list(map(str, model.classes)), probabilities(model, np.stack([kernels.glyph_features(g) for g in glyphs])), NETWORK_WEIGHT)]
    weights = {kind: w for kind, _, _, w in (PIXEL, SAMPLE, ZONING)}
    outputs += [(m.classes, m.proba(glyphs), weights[m.kind]) for m in sorted(memories, key=lambda m: [PIXEL[0], SAMPLE[0], ZONING[0]].index(m.kind))]
    if not outputs:
        raise ValueError("no model is given")
    classes, p = ensemble(outputs)
    named = [dict(zip(classes, row.tolist(), strict=True)) for row in p]
    labels = reading.refine([classes[k] for k in p.argmax(axis=1)], named, glyphs)
    for m in memories:
        if m.kind == SAMPLE[0]:
            q = m.proba(glyphs)
            labels = reading.override([m.classes[k] for k in q.argmax(axis=1)], q.max(axis=1).tolist(), labels)
    return {"labels": labels, "confidences": p.max(axis=1).tolist(), "top": [reading.top_k(row) for row in named]}


def _row(image_id, a, found, n_chars, source, angle, labels, confidences, plate_format: bool, top=()) -> dict:
    text = reading.postprocess(labels, confidences, plate_format=plate_format)
    report = reading.summary(str(image_id), a.shape, len(found), angle, n_chars, text["raw_text"])
    lines = [f"{i + 1}: " + ", ".join(f"{c} {v:.3f}" for c, v in best) for i, best in enumerate(top)]
    return {"source": source, "candidates": len(found), "angle": angle, "n_chars": n_chars, **text, "summary": "\n".join([report, *lines])}


def analyze(df: DataFrame, model, memories: tuple[Templates, ...] = ()) -> DataFrame:
    """Region choice, ensemble, refinement, override, report: a row for each packed gray image."""

    def make(image_id, a):
        enhanced = plates.enhance(a)
        found = plates.detect(enhanced)
        best = plates.choose_region(enhanced, found)
        chars = [c["glyph"] for c in best["chars"]]
        read = classify_glyphs(model, chars, memories) if chars else {"labels": [], "confidences": [], "top": []}
        return [_row(image_id, a, found, len(chars), best["source"], best["angle"], read["labels"], read["confidences"], False, read["top"])]

    return packed.rows(df, RESULT, make)


def recognize(df: DataFrame, model, plate_format: bool = False) -> DataFrame:
    """The first candidate and the classifier's own labels alone; empty text where nothing is found."""

    def make(image_id, a):
        enhanced = plates.enhance(a)
        found = plates.detect(enhanced)
        chars, angle = [], None
        if found:
            plate, angle = plates.normalize(enhanced, plates.coerce_box(found[0]))
            chars = [g["glyph"] for g in segment(plate)]
        p = probabilities(model, np.stack([kernels.glyph_features(g) for g in chars])) if chars else np.zeros((0, 1))
        labels = [str(model.classes[k]) for k in p.argmax(axis=1)]
        return [_row(image_id, a, found, len(chars), "detector_0" if found else "none", angle, labels, p.max(axis=1, initial=0.0).tolist(), plate_format)]

    return packed.rows(df, RESULT, make)


def train_and_save(spark: SparkSession, glyphs: DataFrame, path: str, name: str, seed: int = 42, holdout: float = 0.2, **options) -> dict:
    """Trains a network, saves it with its report and returns the report."""
    model, accuracy = train(glyphs, holdout=holdout, seed=seed, **options)
    report = {"source": name, "n_classes": len(model.classes), "holdout_accuracy": accuracy, "first_loss": model.losses[0], "last_loss": model.losses[-1], "seed": seed}
    save_mlp(spark, model, path, report)
    return report


def train_synthetic(spark: SparkSession, path: str, chars: str = images.CHARS, per_class: int = 600, epochs: int = 90, batch: int = 256, rate: float = 0.02, hidden: tuple = (160, 96), seed: int = 42) -> dict:
    """The network for made-up plate characters, a fifth of them held out."""
    return train_and_save(spark, images.synthetic_glyphs(spark, chars, per_class, seed), path, "synthetic", seed, epochs=epochs, batch=batch, rate=rate, hidden=hidden)


def train_handwritten(spark: SparkSession, files: tuple[str, str, str] | str, path: str, chars: str = images.CHARS, per_class: int = 120, epochs: int = 120, batch: int = 128, rate: float = 0.03, hidden: tuple = (128, 64), seed: int = 42) -> dict:
    """The network for handwritten characters of unpacked files (images, labels, mapping) or a zipped archive."""
    if isinstance(files, str):
        glyphs = images.emnist_archive(spark, files, chars, per_class=per_class, seed=seed)
    else:
        glyphs = images.emnist_rows(spark, *files, chars, per_class, seed)
    return train_and_save(spark, glyphs, path, "handwritten", seed, epochs=epochs, batch=batch, rate=rate, hidden=hidden)


def train_templates(spark: SparkSession, path: str, which: tuple, chars: str = images.CHARS, per_class: int | None = None, seed: int | None = None) -> Templates:
    """Pixel or zoning templates of made-up characters, saved; `which` is PIXEL or ZONING."""
    kind, most, temperature, _ = which
    defaults = {"pixel": (1000, 321), "zoning": (900, 123)}[kind]
    per_class, seed = per_class or defaults[0], defaults[1] if seed is None else seed
    model = train_template_model(images.synthetic_glyphs(spark, chars, per_class, seed), kind, most, temperature, seed)
    save_template_model(spark, model, path)
    return model


def sample_glyphs(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_id, label, h, w, data): glyphs of labelled packed images, each named by its place.

    An image whose chosen region has not as many glyphs as its label has characters is an error.
    `df` has image_id, `labels` image_id and expected."""

    def make(row):
        a = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w)
        enhanced = plates.enhance(a)
        best = plates.choose_region(enhanced, plates.detect(enhanced))
        chars = [c["glyph"] for c in best["chars"]]
        if len(chars) != len(row.expected):
            raise ValueError(f"image {row.image_id}: {len(row.expected)} glyphs expected, {len(chars)} found")
        return list(zip(row.expected, chars, strict=True))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(f"{row.image_id}:{i}", c, *g.shape, g.tobytes()) for row in pdf.itertuples() for i, (c, g) in enumerate(make(row))]
            yield pd.DataFrame(out, columns=["sample_id", "label", "h", "w", "data"])

    both = df.join(labels.select("image_id", "expected"), "image_id")
    return both.select("image_id", "h", "w", "data", "expected").mapInPandas(run, "sample_id string, label string, h int, w int, data binary")


def train_samples(spark: SparkSession, df: DataFrame, labels: DataFrame, path: str, seed: int = 42) -> Templates:
    """The memory of labelled images, saved."""
    kind, most, temperature, _ = SAMPLE
    model = train_template_model(sample_glyphs(df, labels), kind, most, temperature, seed)
    save_template_model(spark, model, path)
    return model


def evaluate(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, wrong) over (filename, expected) and (filename, predicted); a label without a result is an error."""
    both = labels.join(results.select("filename", "predicted"), "filename", "left")
    checked = F.when(F.col("predicted").isNull(), F.raise_error(F.concat(F.lit("no result for "), "filename")).cast("string")).otherwise(F.col("predicted"))
    return both.agg(F.count("*").alias("n"), F.count_if(checked != F.col("expected")).alias("wrong"))
