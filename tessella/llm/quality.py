"""Quality by regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance shrunk towards its scaled identity; the score is the
logistic of the difference of log densities and log priors. Mahalanobis distances come by
forward substitution in Cholesky factors that are made once and kept with the model.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.sampling import labelled, remainder

TRAIN_ROWS = 20_000
SHRINKAGE = 0.05
THRESHOLD = 0.3
MODULUS, HELD = 5, 0
#: Byte classes. 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 common marks, 6 symbols.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-", b"!?*&%$#|@~^_+=<>{}[]\\/`"), 1):
    _CLASS[list(_chars)] = _k
FEATURES = ("log_bytes", "upper", "digit", "white", "marks", "symbols", "pipes", "bangs", "word_size", "adjacent", "repeated", "line_repeats")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; shares enter as log(share + 0.002)."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=7) / max(len(data), 1)
    words = text.split()
    n = max(len(words), 1)
    counted = set(words)
    lines = text.split("\n")
    shares = [kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], text.count("|") / n, text.count("!") / n]
    repeats = [sum(map(eq, words, words[1:])) / n, max(0.0, 1 - len(counted) / n), 1 - len(set(lines)) / len(lines)]
    return [np.log1p(len(data)), *(np.log(s + 0.002) for s in shares), np.log1p(len(text) / n), *(np.log(s + 0.002) for s in repeats)]


@dataclass
class QuadraticDiscriminant:
    means: list[np.ndarray]
    covariances: list[np.ndarray]
    log_priors: list[float]
    cholesky: list[np.ndarray] = field(init=False)
    log_det: list[float] = field(init=False)

    def __post_init__(self):
        self.cholesky = [np.linalg.cholesky(c) for c in self.covariances]
        self.log_det = [2 * float(np.log(np.diag(c)).sum()) for c in self.cholesky]

    @staticmethod
    def _whitened(factor: np.ndarray, x: np.ndarray) -> np.ndarray:
        """z with factor @ z = x, row by row of the lower triangle."""
        z = np.empty_like(x)
        for i, row in enumerate(factor):
            z[i] = (x[i] - row[:i] @ z[:i]) / row[i]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(x), self.log_priors[0])
        density = []
        for mean, factor, log_det, prior in zip(self.means, self.cholesky, self.log_det, self.log_priors, strict=True):
            z = self._whitened(factor, (x - mean).T)
            density.append(prior - 0.5 * (log_det + (z * z).sum(axis=0)))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> QuadraticDiscriminant:
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return QuadraticDiscriminant([], [], [float((y.sum() + 1) / (len(y) + 2))])
    means, covariances, priors = [], [], []
    for k in (0, 1):
        own = x[y == k]
        centred = own - own.mean(axis=0)
        cov = centred.T @ centred / max(len(own) - 1, 1)
        level = np.trace(cov) / len(cov) + 1e-6
        means.append(own.mean(axis=0))
        covariances.append((1 - shrinkage) * cov + shrinkage * level * np.eye(len(cov)))
        priors.append(float(np.log(len(own) / len(x))))
    return QuadraticDiscriminant(means, covariances, priors)


def _features(df: DataFrame, first: str, kind: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [first, "x"])

    return df.select(first, "text").mapInArrow(run, f"{first} {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 5) -> QuadraticDiscriminant:
    """Learns from at most `rows` labelled documents; the held-out fold is never read."""
    got = _features(labelled(docs, labels, "quality", MODULUS, HELD, rows, seed), "label", "int").collect()
    got = sorted((r.label, tuple(r.x)) for r in got)
    return fit(np.array([x for _, x in got]).reshape(-1, len(FEATURES)), np.array([k for k, _ in got], int))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and empty texts have the statistics of the empty text; with no labels, or one class
    alone, every score is that class's smoothed share. A long text is read whole. Of different
    labels for one id the greater counts. Repeated rows are kept, rows with null doc_id are
    scored (held_out false); an empty table gives no rows; other columns are ignored, clashing
    names too."""
    model = train(docs, labels)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
