"""Toxicity by a factorization machine over hashed terms.

Terms are words and their prefixes of four and five letters, hashed to 2^22 buckets. The
score is the logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j with x_i = 1 for a
term that occurs anywhere in the text: the factors learn pairs, such as an insult beside a
mention of a group, and presence does not fade in long texts.

The machine runs over the buckets that tell something of the label, alone or in a pair, so
that the many others add no noise. Alone: by chi-square, at a level divided by the number of
buckets. In a pair: by the residuals of the additive model, summed over the rows that hold the
bucket and any other one (a random projection of the rows gives the sums over all partners at
once); the bar is the greatest value that any bucket reaches with shuffled residuals. Neither
way has a limit on how many pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.sampling import labelled, remainder

BUCKETS = 1 << 22
#: Bounds of the sample that the machine is learnt from: labelled rows, and their terms.
TRAIN_ROWS = 8_000
TRAIN_TERMS = 16_000_000
FACTORS = 4
#: Training rows that hold a bucket, at least; fewer cannot reach the level of either test.
SUPPORT = 5
LEVEL = 0.05
PROJECTIONS, SHUFFLES = 16, 4
THRESHOLD = 0.7
MODULUS, HELD = 3, 1
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 200_000
#: Texts of a batch that are held as Python strings at once.
TEXTS = 256


def word_terms(word: str) -> list[int]:
    names = [f"w:{word}"] + [f"{n}:{word[:n]}" for n in (4, 5) if len(word) >= n]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in names]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _slices(batches):
    """The rows of all batches in their order, at most TEXTS at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            yield batch.slice(k, TEXTS)


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Each row: positions in `terms`, without repeats."""
        out = np.empty(len(rows))
        for k, at in enumerate(rows):
            v = self.factors[at]
            out[k] = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


class _Rows:
    """Distinct terms of rows as one long list, with sums by row and by term."""

    def __init__(self, n: int, terms: np.ndarray, place: np.ndarray, owner: np.ndarray):
        self.n, self.terms, self.place, self.owner = n, terms, place, owner

    @classmethod
    def of(cls, rows: list[np.ndarray], support: int) -> _Rows:
        """The terms that `support` rows hold."""
        joined = np.concatenate(rows).astype(np.int32)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        terms, count = np.unique(joined, return_counts=True)
        terms = terms[count >= support]
        place = np.searchsorted(terms, joined).astype(np.int32)
        inside = place < len(terms)
        inside[inside] = terms[place[inside]] == joined[inside]
        return cls(len(rows), terms.astype(np.int64), place[inside], owner[inside])

    def only(self, good: np.ndarray) -> _Rows:
        inside = good[self.place]
        return _Rows(self.n, self.terms[good], (np.cumsum(good) - 1).astype(np.int32)[self.place[inside]], self.owner[inside])

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Per row the sum of `values` (one a term) over its terms."""
        return np.bincount(self.owner, weights=values[self.place], minlength=self.n)

    def by_term(self, values: np.ndarray) -> np.ndarray:
        """Per term the sum of `values` (one a row) over its rows."""
        return np.bincount(self.place, weights=values[self.owner], minlength=len(self.terms))


def _descend(x: _Rows, y: np.ndarray, factors: int, rng, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the logistic loss."""
    n, t = x.n, len(x.terms)
    p = y.mean()
    params = [np.array([np.log(p / (1 - p))]), np.zeros(t), rng.normal(0, 0.05, (t, factors))]
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for step in range(1, steps + 1):
        bias, w, v = params
        xv = np.stack([x.by_row(v[:, f]) for f in range(factors)], axis=1) if factors else np.zeros((n, 0))
        z = bias[0] + x.by_row(w - 0.5 * (v**2).sum(axis=1)) + 0.5 * (xv**2).sum(axis=1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        xg = x.by_term(g)
        grads = [np.array([g.sum()]), xg + 1e-4 * w, np.stack([x.by_term(g * xv[:, f]) for f in range(factors)], axis=1) - xg[:, None] * v + 1e-4 * v if factors else v]
        for k, d in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            params[k] = params[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def _alone(x: _Rows, y: np.ndarray) -> np.ndarray:
    """Terms whose rows' share of label 1 differs from that of all rows."""
    total, hits, p = x.by_term(np.ones(x.n)), x.by_term(y), y.mean()
    chi = (hits - total * p) ** 2 / (total * p * (1 - p)) * x.n / np.maximum(x.n - total, 1)
    # The chi-square (one degree) that a share LEVEL / terms of noise passes.
    return chi >= NormalDist().inv_cdf(1 - LEVEL / (2 * max(1, len(x.terms)))) ** 2


def _paired(x: _Rows, residual: np.ndarray, rng) -> np.ndarray:
    """Terms whose rows, together with those of any partner, lean to one side of the residual."""
    size = x.by_row(np.ones(len(x.terms)))
    signs = rng.choice([-1.0, 1.0], (PROJECTIONS, len(x.terms)))
    dealt = [residual] + [rng.permutation(residual) for _ in range(SHUFFLES)]
    energy = np.zeros((len(dealt), len(x.terms)))
    for s in signs:
        sums = x.by_row(s)
        for k, r in enumerate(dealt):
            energy[k] += (x.by_term(r * sums) - s * x.by_term(r)) ** 2
    energy /= np.maximum(x.by_term(size - 1), 1.0)
    return energy[0] > energy[1:].max(initial=0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7, steps: int = 300) -> FactorizationMachine:
    """Rows of distinct buckets and their labels; rows of equal buckets and label count once."""
    first = {}
    for i, r in enumerate(rows):
        first.setdefault((np.sort(r).tobytes(), int(labels[i])), i)
    keep = sorted(first.values())
    rows, y = [rows[i] for i in keep], labels[keep].astype(float)
    n, positive = len(y), y.sum()
    none = FactorizationMachine(np.empty(0, np.int64), float(np.log((positive + 1) / (n - positive + 1))), np.empty(0), np.empty((0, FACTORS)))
    if positive in (0, n):
        return none
    x, rng = _Rows.of(rows, SUPPORT), np.random.default_rng(seed)
    alone = _alone(x, y)
    linear = x.only(alone)
    bias, w, _ = _descend(linear, y, 0, rng, steps // 3)
    residual = y - 1 / (1 + np.exp(-np.clip(bias + linear.by_row(w), -30, 30)))
    x = x.only(alone | _paired(x, residual, rng))
    if not len(x.terms):
        return none
    return FactorizationMachine(x.terms, *_descend(x, y, FACTORS, rng, steps))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_terms: int = TRAIN_TERMS, seed: int = 3) -> FactorizationMachine:
    """Learns from at most `rows` labelled documents, in the order of their ids' hashes as long
    as their terms are `most_terms` at most; the held-out fold is never read. The sample's terms
    are kept on the executors' disks until both readings are done, and not checkpointed: each file
    of a checkpoint lets an executor start processes that set its mode."""

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            terms = [np.unique(np.array([b for w in words(t) for b in word_terms(w)], "<i4")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in terms], pa.int32()), pa.array([t.tobytes() for t in terms], pa.binary())], ["place", "label", "size", "terms"])

    sample = labelled(docs, labels, "toxic", MODULUS, HELD, rows, seed).select(F.xxhash64("doc_id", F.lit(seed)).alias("place"), "label", "text")
    sample = sample.mapInArrow(run, "place long, label int, size int, terms binary").persist(StorageLevel.DISK_ONLY)
    try:
        sizes = sample.groupBy("place").agg(F.sum("size").alias("size")).orderBy("place").toArrow()
        places = sizes.column("place").to_numpy()
        fits = np.cumsum(sizes.column("size").to_numpy()) <= most_terms
        if not fits.any():
            return FactorizationMachine(np.empty(0, np.int64), 0.0, np.empty(0), np.empty((0, FACTORS)))
        got = sample.where(F.col("place") <= int(places[fits][-1])).select("label", "terms").toArrow()
    finally:
        sample.unpersist()
    y = got.column("label").to_numpy()
    x = [np.frombuffer(b.as_py(), "<i4") for b in got.column("terms")]
    order = sorted(range(len(y)), key=lambda i: (x[i].tobytes(), y[i]))
    return fit([x[i] for i in order], y[order])


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) for every row, in one pass without a shuffle."""

    def run(batches):
        import pyarrow as pa

        place, known = {int(b): i for i, b in enumerate(model.terms)}, {}
        for batch in _slices(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                at = set()
                for w in words(t):
                    got = known.get(w)
                    if got is None:
                        if len(known) >= _CACHE_WORDS:
                            known.clear()
                        got = known[w] = tuple(place[b] for b in word_terms(w) if b in place)
                    at.update(got)
                rows.append(sorted(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(rows), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and empty texts have no terms and get the bias alone; without labelled rows every
    score is 0.5, with one class alone it is that class's smoothed share. A long text is read
    whole. Of different labels for one id the greater counts. Repeated rows are kept, rows with
    null doc_id are scored (held_out false); an empty table gives no rows; other columns are
    ignored, clashing names too."""
    scored = score(docs, train(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
