"""Models as Parquet folders with a JSON line of metadata; a model that is not fitted is refused."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from tessella.operators.classify import Mlp


def save_mlp(spark: SparkSession, model: Mlp, path: str, metadata: dict | None = None) -> None:
    if not model.layers:
        raise ValueError("the model is not fitted")
    meta = {"model_type": "mlp", "classes": model.classes, **(metadata or {})}
    rows = [(i, list(w.shape), w.ravel().tolist(), b.tolist(), json.dumps(meta, sort_keys=True)) for i, (w, b) in enumerate(model.layers)]
    spark.createDataFrame(rows, "layer int, shape array<int>, weights array<double>, bias array<double>, metadata string").coalesce(1).write.mode("overwrite").parquet(path)


def load_mlp(spark: SparkSession, path: str) -> tuple[Mlp, dict]:
    rows = spark.read.parquet(path).orderBy("layer").collect()
    meta = json.loads(rows[0].metadata)
    if meta.get("model_type") != "mlp":
        raise ValueError("not a neural network")
    model = Mlp()
    model.layers = [(np.array(r.weights).reshape(r.shape), np.array(r.bias)) for r in rows]
    model.classes = meta["classes"]
    return model, meta


def save_templates(spark: SparkSession, rows: list[tuple[str, list[float]]], path: str, kind: str, temperature: float) -> None:
    if not rows:
        raise ValueError("the model is not fitted")
    meta = json.dumps({"model_type": kind, "temperature": temperature}, sort_keys=True)
    spark.createDataFrame([(label, [float(v) for v in vec], meta) for label, vec in rows], "label string, vec array<double>, metadata string").write.mode("overwrite").parquet(path)


def load_templates(spark: SparkSession, path: str, kind: str):
    df = spark.read.parquet(path)
    meta = json.loads(df.first().metadata)
    if meta.get("model_type") != kind:
        raise ValueError(f"not a {kind} model")
    return df.select("label", "vec"), meta


def load_template_model(spark: SparkSession, path: str, kind: str):
    """The templates of a folder as a classifier."""
    from tessella.operators.templates import Templates

    df, meta = load_templates(spark, path, kind)
    rows = df.collect()
    return Templates(kind, meta["temperature"], np.array([r.vec for r in rows]), np.array([r.label for r in rows]))


def save_template_model(spark: SparkSession, model, path: str) -> None:
    save_templates(spark, list(zip(map(str, model.labels), model.vectors.tolist(), strict=True)), path, model.kind, model.temperature)


def first_model(spark: SparkSession, paths: list[str]) -> tuple[Mlp, dict] | None:
    """The first network that is there, in the order of `paths`; None without any."""
    jvm = spark._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return load_mlp(spark, path)
    return None
