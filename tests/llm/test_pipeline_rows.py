import random

import corpus_pipeline
from pyspark.sql import functions as F

from tessella.llm import simhash

SCHEMA = "doc_id long, text string, source string"
RNG = random.Random(4)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(5000)]


def prose():
    return " ".join(RNG.choices(WORDS, k=120))


X, Y, Z = prose(), prose(), prose()
ITEM = "the secret answer of this benchmark item is seven of nine"
ODD = [prose() for _ in range(4)]


def folder(spark, path, rows, labels=()):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def left(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_near_duplicates_are_dropped_by_row(spark, tmp_path):
    rows = [(5, X), (5, Y), (3, Y), (None, Z), (8, Z), (None, ODD[0]), (None, ODD[1]), (7, ODD[2]), (7, ODD[3]), (None, ODD[0])]
    docs = folder(spark, str(tmp_path), [(d, t, "a") for d, t in rows])
    want = [(5, X), (3, Y), (8, Z), (None, ODD[0]), (None, ODD[1]), (7, ODD[2]), (7, ODD[3])]
    assert left(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))) == sorted(want, key=str)


def test_contaminated_rows_take_no_others_along(spark, tmp_path):
    rows = [(None, f"{X} {ITEM} {Y}"), (None, X), (4, f"{ITEM} {Z}"), (4, Z), (None, Y), (6, None)]
    docs = folder(spark, str(tmp_path), [(d, t, "a") for d, t in rows])
    want = [(None, X), (4, Z), (None, Y), (6, None)]
    assert left(corpus_pipeline.decontaminated(spark, docs, str(tmp_path))) == sorted(want, key=str)


def test_toxic_rows_take_no_others_along(spark, tmp_path):
    bad = [(100 + i, f"vile filth {prose()}") for i in range(60)]
    good = [(300 + i, prose()) for i in range(60)]
    labels = [(d, 1, int(d < 300)) for d, _ in bad + good]
    rows = [(None, f"{X} vile filth"), (None, X), (2, f"{Y} vile filth"), (2, Y), (None, Z)]
    docs = folder(spark, str(tmp_path), [(d, t, "a") for d, t in bad + good + rows], labels)
    got = [r for r in left(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))) if r[0] is None or r[0] < 100]
    assert got == sorted([(None, X), (2, Y), (None, Z)], key=str)


def test_near_duplicate_stage_broadcasts_no_expanded_keys(spark, monkeypatch):
    """Whatever Spark thinks of the keys' number, the driver gets none of them."""
    plans = []

    def held(df):
        out = durable(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    durable = simhash.durable
    monkeypatch.setattr(simhash, "durable", held)
    texts = [prose() for _ in range(12)]
    docs = spark.createDataFrame([(i, texts[i // 2]) for i in range(24)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 24, 2))
    joined = [p for p in plans if "MapInArrow" in p and "Join" in p]
    assert joined and not any("BroadcastExchange" in p for p in joined)


def test_near_duplicate_stage_sends_the_driver_no_rows(spark, monkeypatch):
    """Of many copies neither members nor dropped rows are broadcast, only words of 64 row keys."""
    plans, words = [], []

    def held(df):
        out = durable(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        words.append((out.columns, out.count()))
        return out

    durable = simhash.durable
    for module in (simhash, corpus_pipeline):
        monkeypatch.setattr(module, "durable", held)
    texts = [prose() for _ in range(3)]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(1200)], "doc_id long, text string").coalesce(2)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 1, 2]
    assert not any("BroadcastExchange" in p for p in plans)
    assert words[-1][0] == [f"{corpus_pipeline.ROW}_word", f"{corpus_pipeline.ROW}_bits"] and words[-1][1] <= 1200 / 64 + 2


def test_dropped_rows_are_the_ones_whose_bits_are_set(spark):
    """First, last and sign bit of a word, keys of several parts, repeated keys, none and all."""
    docs = spark.range(0, 1000, 1, 5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    keyed = corpus_pipeline._keyed(spark, docs)
    for gone in ({0, 63, 64, 127, 199, 200, 263, 462, 999}, set(), set(range(1000))):
        rows = keyed.where(F.col("doc_id").isin(list(gone)) if gone else F.lit(False)).select(F.col(corpus_pipeline.ROW).alias("doc_id"))
        got = corpus_pipeline._without(keyed, rows.union(rows))
        assert got.columns == ["doc_id", "text"]
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(range(1000)) - gone)
