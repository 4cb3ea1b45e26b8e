"""Classifiers over feature vectors: nearest neighbours, templates, a neural network, blending."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.relational import softmax

#: Rows of a block of queries and of a block of searched rows: a pair of blocks is one product.
QUERY_BLOCK, SEARCH_BLOCK = 512, 4_096
#: Bytes of query vectors that may be broadcast; beyond, blocks of both sides are paired by a shuffle.
BROADCAST_BYTES = 32 << 20


def vectors(glyphs: DataFrame) -> DataFrame:
    """(image_id, label, vec): row-major levels of LONG glyphs."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return glyphs.groupBy("image_id", "label").agg(cells.alias("c")).select("image_id", "label", F.transform("c", lambda c: c["v"].cast("long")).alias("vec"))


def _blocks(df: DataFrame, size: int, prefix: str, *names: str) -> DataFrame:
    """Rows gathered into arrays of about `size` (a block holds no more than a few times that)."""
    n = max(1, -(-df.count() // size))
    block = F.pmod(F.xxhash64("image_id"), F.lit(n)).alias(f"{prefix}_block")
    return df.groupBy(block).agg(F.collect_list(F.struct(*names)).alias(prefix))


def nearest(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(image_id, train_id, label, d): stated queries against every row but their own id, in blocks.

    Of each pair of blocks a query keeps its k nearest rows and the nearest of each class (ties by
    train_id), so that few rows of all pairs leave a task. Vectors are whole numbers: d is exact."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = _blocks(queries, QUERY_BLOCK, "q", "image_id", "vec")
    t = _blocks(train, SEARCH_BLOCK, "t", "image_id", "label", "vec")
    size = queries.agg(F.coalesce(F.sum(F.size("vec") * 8 + 16), F.lit(0))).first()[0]
    kind = dict(train.dtypes)["label"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                ids, train_ids = (np.array([x["image_id"] for x in part], np.int64) for part in (row.q, row.t))
                labels = np.array([x["label"] for x in row.t])
                a, b = (np.array([x["vec"] for x in part], float) for part in (row.q, row.t))
                order = np.argsort(train_ids, kind="stable")
                train_ids, labels, b = train_ids[order], labels[order], b[order]
                d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
                d[ids[:, None] == train_ids[None, :]] = np.inf
                chosen = np.zeros(d.shape, bool)
                np.put_along_axis(chosen, np.argsort(d, axis=1, kind="stable")[:, :k], True, axis=1)
                for c in np.unique(labels):
                    own = np.flatnonzero(labels == c)
                    chosen[np.arange(len(ids)), own[d[:, own].argmin(axis=1)]] = True
                i, j = np.nonzero(chosen & np.isfinite(d))
                yield pd.DataFrame({"image_id": ids[i], "train_id": train_ids[j], "label": labels[j], "d": np.rint(d[i, j]).astype(np.int64)})

    pairs = t.crossJoin(F.broadcast(q)) if size <= BROADCAST_BYTES else t.crossJoin(q)
    return pairs.select("q", "t").mapInPandas(run, f"image_id long, train_id long, label {kind}, d long")


def shares_of_nearest(near: DataFrame, k: int) -> DataFrame:
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy("d", "train_id"))).where(F.col("r") <= k)
    share = F.count("*") / F.sum(F.count("*")).over(Window.partitionBy("image_id"))
    return first.groupBy("image_id", "label").agg(share.alias("p"))


def softmax_of_nearest(near: DataFrame, temperature: float = 0.035) -> DataFrame:
    least = near.groupBy("image_id", "label").agg(F.min("d").alias("d"))
    size = float(64 * 255 * 255)
    return softmax(least.select("image_id", "label", (-(F.col("d") / size) / temperature).alias("z")), "z").select("image_id", "label", "p")


def knn(queries: DataFrame, train: DataFrame, k: int = 3) -> DataFrame:
    """(image_id, label, p): vote shares of the k nearest, ties by training id."""
    return shares_of_nearest(nearest(queries, train, k), k)


def templates(queries: DataFrame, train: DataFrame, temperature: float = 0.035) -> DataFrame:
    """(image_id, label, p): softmax of minus the least mean squared difference of a class."""
    return softmax_of_nearest(nearest(queries, train, 1), temperature)


def blended_search(queries: DataFrame, train: DataFrame, k: int = 3) -> DataFrame:
    """Templates and neighbours from one search, blended."""
    near = nearest(queries, train, k)
    return blend([(softmax_of_nearest(near), 0.2), (shares_of_nearest(near, k), 0.7)])


def blend(outputs: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean over the union of classes; a class a model lacks counts 0."""
    total = sum(w for _, w in outputs)
    parts = [df.select("image_id", "label", (F.col("p") * (w / total)).alias("p")) for df, w in outputs]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    summed = whole.groupBy("image_id", "label").agg(F.sum("p").alias("p"))
    return summed.withColumn("p", F.col("p") / F.greatest(F.lit(1e-8), F.sum("p").over(Window.partitionBy("image_id"))))


class Mlp:
    """ReLU layers and softmax, trained by mini-batch descent."""

    def __init__(self, hidden=(128, 64), rate=0.01, epochs=50, batch=32, l2=0.0, seed=42):
        if rate <= 0 or epochs <= 0 or batch <= 0 or any(h <= 0 for h in hidden):
            raise ValueError("rate, epochs, batch and layer sizes must be positive")
        self.hidden, self.rate, self.epochs, self.batch, self.l2, self.seed = hidden, rate, epochs, batch, l2, seed
        self.layers, self.classes, self.losses = [], [], []

    def _forward(self, x):
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i + 1 < len(self.layers) else z)
        e = np.exp(out[-1] - out[-1].max(axis=1, keepdims=True))
        out[-1] = e / e.sum(axis=1, keepdims=True)
        return out

    def fit(self, x, y):
        x = np.atleast_2d(np.asarray(x, float))
        if len(x) != len(y):
            raise ValueError("as many labels as rows are needed")
        rng = np.random.default_rng(self.seed)
        self.classes = sorted(set(map(str, y)))
        want = np.array([self.classes.index(str(v)) for v in y])
        sizes = [x.shape[1], *self.hidden, len(self.classes)]
        self.layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        for _ in range(self.epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), self.batch):
                rows = order[a : a + self.batch]
                acts = self._forward(x[rows])
                d = acts[-1].copy()
                d[np.arange(len(rows)), want[rows]] -= 1
                d /= len(rows)
                for i in range(len(self.layers) - 1, -1, -1):
                    w, b = self.layers[i]
                    back = (d @ w.T) * (acts[i] > 0) if i else None
                    self.layers[i] = (w - self.rate * (acts[i].T @ d + self.l2 * w), b - self.rate * d.sum(axis=0))
                    d = back
            p = self._forward(x)[-1][np.arange(len(x)), want]
            self.losses.append(float(-np.log(np.clip(p, 1e-8, 1)).mean()))
        return self

    def proba(self, x):
        if not self.layers:
            raise ValueError("the model is not fitted")
        return self._forward(np.atleast_2d(np.asarray(x, float)))[-1]


def mlp(queries: DataFrame, train: DataFrame, rows: int = 5_000, **options) -> DataFrame:
    """(image_id, label, p): fitted on at most `rows` training vectors, applied to all."""
    got = train.orderBy(F.xxhash64("image_id"), "image_id").limit(rows).select("label", "vec").collect()
    model = Mlp(**options).fit([[v / 255 for v in r.vec] for r in got], [r.label for r in got])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                p = model.proba(np.stack(pdf.vec.to_list()) / 255)
                yield pd.DataFrame({"image_id": np.repeat(pdf.image_id.to_numpy(), len(model.classes)), "label": [int(c) for c in model.classes] * len(pdf), "p": p.ravel()})

    return queries.select("image_id", "vec").mapInPandas(run, "image_id long, label int, p double")
