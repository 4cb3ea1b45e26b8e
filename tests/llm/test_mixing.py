import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing


def quantile(rate, u):
    """Counts k from 0 while the distribution function, summed from logarithms, is at most u."""
    k, cdf = 0, math.exp(-rate)
    while cdf <= u:
        k += 1
        cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def u_of(doc_id):
    return int(hashlib.md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)


@pytest.mark.parametrize("rate", [0.4, 39.0, 499.0, 501.0, 2_000.0, 90_000.0])
def test_counts_invert_the_distribution_at_any_rate(spark, rate):
    df = spark.createDataFrame([(i, "a") for i in range(12)], "doc_id long, source string")
    got = mixing.mix(df, size=rate * 12).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.countDistinct("copy").alias("d"), F.max("copy").alias("c")).collect()
    want = {i: quantile(rate, u_of(i)) for i in range(12)}
    assert {r.doc_id: r.n for r in got} == {i: n for i, n in want.items() if n}
    assert all(r.n == r.m == r.d == r.c for r in got)


def test_one_row_source_beside_a_large_one(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "big").alias("source"))
    got = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got[None] == quantile(20_000.0, u_of(0)) and abs(got["big"] - 20_000) < 700


def test_many_sources_without_a_broadcast(spark, monkeypatch):
    rows = [(i, "big" if i % 2 else f"s{i % 50}" if i % 100 else None, "text") for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(mixing, "HOT", 4)
    assert sorted(map(str, mixing.mix(df).collect())) == want
