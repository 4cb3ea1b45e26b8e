import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("module", "op", "target", "recall"), [(toxicity, toxicity.toxicity, "toxic", 0.7), (quality, quality.quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, op, target, recall):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = op(docs.withColumn("score", F.lit("clash")).withColumn("label", F.lit(9)), labels).join(labels, "doc_id").where("held_out").toPandas()
    y, p = got[target], got.predicted
    assert ((y == 1) & (p == 1)).sum() / (y == 1).sum() > recall
    assert ((y == 0) & (p == 1)).sum() / (y == 0).sum() < 0.03
    assert got.score.between(0, 1).all() and ((got.score >= module.THRESHOLD) == (p == 1)).all()


@pytest.mark.parametrize(("op", "target"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_odd_rows_and_tables(spark, op, target):
    rows = [(1, None), (2, ""), (2, ""), (3, "x " * 60_000), (None, "null id"), (4, "a stupid idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], f"doc_id long, {target} int")
    assert op(docs, labels).count() == len(rows)
    none = op(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.held_out for r in none if r.doc_id is None} == {False}
    assert op(docs.limit(0), labels).count() == 0


def test_pairs_are_learnt():
    """Label 1 only where both terms meet: no additive score can part these."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(800):
        a, b = rng.random(2) < 0.5
        noise = rng.integers(1000, 100_000, 6)
        rows.append(np.unique([*([10] * int(a)), *([20] * int(b)), *noise]))
        y.append(int(a and b))
    model = toxicity.fit(rows, np.array(y))
    assert set(model.terms) >= {10, 20}
    at = {int(t): i for i, t in enumerate(model.terms)}
    one, other, both = model.score([[at[10]], [at[20]], [at[10], at[20]]])
    assert both > 0.9 and one < 0.2 and other < 0.2


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.array([0] * 200 + [1] * 300)
    m = quality.fit(x, y)
    logs = [m.log_priors[k] - 0.5 * (np.linalg.slogdet(m.covariances[k])[1] + np.einsum("ij,jk,ik->i", x - m.means[k], np.linalg.inv(m.covariances[k]), x - m.means[k])) for k in (0, 1)]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30))))


def test_exclusive_terms_are_learnt():
    """Label 1 where one of two terms stands without the other: neither tells anything alone."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(800):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique([*([10] * int(a)), *([20] * int(b)), *rng.integers(1000, 100_000, 6)]))
        y.append(int(a != b))
    model = toxicity.fit(rows, np.array(y))
    at = {int(t): i for i, t in enumerate(model.terms)}
    one, other, both, none = model.score([[at[10]], [at[20]], [at[10], at[20]], []])
    assert min(one, other) > 0.9 and max(both, none) < 0.1


def test_scores_of_the_whole_query_equal_plain_sums(spark):
    """Every score of op4 is the logistic of bias, weights and all pairs, term by term."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    at = {int(t): i for i, t in enumerate(model.terms)}
    text = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(text) and model.terms.size > 0
    for r in got:
        terms = sorted({at[b] for w in toxicity._WORD.findall((text[r.doc_id] or "").lower()) for b in toxicity.word_terms(w) if b in at})
        z = model.bias + sum(model.weights[i] for i in terms) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(terms) for j in terms[:k])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_training_writes_no_checkpoint(spark):
    """The sample of op4 is read twice without files of a checkpoint, and is not kept after that."""
    from pathlib import Path
    from urllib.parse import urlparse

    from tessella.llm.common import shared_root

    shared_root(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before, had = set(folder.rglob("*")), set(kept().keySet())
    sf = "/root/testdata/sf0.01"
    assert toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).terms.size > 0
    assert set(folder.rglob("*")) <= before and set(kept().keySet()) <= had


def test_batches_are_read_in_slices():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + n))], ["x"]) for k, n in ((0, 0), (0, 1000), (1000, 1), (1001, 256))]
    got = list(toxicity._slices(batches))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(1257))
    assert max(b.num_rows for b in got) == toxicity.TEXTS


def test_quality_query_equals_plain_densities(spark):
    """Statistics, fit and scores of op6 from plain loops over the same documents."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}

    def statistics(t):
        data, words, lines = t.encode(), t.split(), t.split("\n")
        n = max(len(words), 1)
        sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-", b"!?*&%$#|@~^_+=<>{}[]\\/`"]
        shares = [sum(c in s for c in data) / max(len(data), 1) for s in sets] + [t.count("|") / n, t.count("!") / n]
        repeats = [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(0, 1 - len(set(words)) / n), 1 - len(set(lines)) / len(lines)]
        return [math.log(1 + len(data)), *(math.log(s + 0.002) for s in shares), math.log(1 + len(t) / n), *(math.log(s + 0.002) for s in repeats)]

    x = {d: np.array(statistics(t)) for d, t in text.items()}
    train = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5]
    sides = []
    for k in (0, 1):
        own = np.array([x[d] for d, q in train if q == k])
        cov = np.cov(own.T)
        cov = 0.95 * cov + 0.05 * (np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
        sides.append((own.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], math.log(len(own) / len(train))))
    for r in quality.quality(docs, labels).collect():
        low, high = (p - 0.5 * (d + (x[r.doc_id] - m) @ inv @ (x[r.doc_id] - m)) for m, inv, d, p in sides)
        assert abs(r.score - 1 / (1 + math.exp(-min(30, max(-30, high - low))))) < 1e-6
