import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontaminate, matroska, mixing, registry, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    got = registry.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_containment_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 14, 40])))) for i in range(60)]
    docs = []
    for d in range(120):
        body = rng.choices(vocabulary, k=rng.choice([0, 4, 30, 400, 6000]))
        item = items[rng.randrange(60)][1].split()
        cut = item[: max(1, round(len(item) * rng.choice([0.5, 0.8, 0.9, 1.0])))]
        at = rng.randrange(len(body) + 1)
        docs.append((d, (", ".join(body[:at]) + " " + " ".join(cut).upper() + "! " + " ".join(body[at:])) if d % 10 else items[d % 60][1]))
    docs += [(500, None), (501, ""), (502, "...")]

    def shingles(t):
        import re

        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    want = {}
    for d, t in docs:
        for i, u in items:
            q = shingles(u)
            n = len(q & shingles(t))
            if q and n >= 0.8 * len(q):
                want[d, i] = n
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("p", F.lit(1))
    it = spark.createDataFrame(items + [(900, None), (901, "")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r.n_common for r in decontaminate.contained_items(df, it).collect()}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len(want) > 30
    assert decontaminate.contained_items(df.limit(0), it).count() == 0 == decontaminate.contained_items(df, it.limit(0)).count()


def test_containment_recall_on_planted_passages(spark):
    """2,000 items of 8 to 60 shingles, four fifths of each inside a document of up to 20,000 words."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items, docs, planted = [], [], set()
    for i in range(2_000):
        words = rng.choices(vocabulary, k=rng.randint(12, 64))
        n = len(words) - 4
        cut = words[: -(-4 * n // 5) + 4]
        body = rng.choices(vocabulary, k=rng.choice([0, 20, 200, 2_000] + [20_000] * (i % 20 == 0)))
        at = rng.randrange(len(body) + 1)
        items.append((i, " ".join(words)))
        docs.append((i, " ".join(body[:at] + cut + body[at:])))
        planted.add((i, i))
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(found & planted) / len(planted) >= 0.999 and found <= planted


def test_mixing_meets_its_targets(spark):
    rows = [(i, f"t{i}", "big" if i % 10 < 7 else "small" if i % 10 < 9 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash")).withColumn("cdf", F.lit(1))
    got = {r.source: r.n for r in mixing.mix(df, {"big": 1, "small": 3, "absent": 5}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert None not in got and abs(got["big"] - 1500) < 150 and abs(got["small"] - 4500) < 270
    even = mixing.mix(df)
    assert {r.source: abs(r.n - 2000) < 200 for r in even.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"big": True, "small": True, None: True}
    assert mixing.mix(df.limit(0)).count() == 0
    keys = [r.shuffle_key for r in even.collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("lacing", ["auto", "none", "xiph", "fixed", "ebml"])
def test_lacing_round_trips(lacing):
    frames = [b"a" * 700, b"b" * 700, b"c" * 700] if lacing == "fixed" else [b"x" * 3000] if lacing == "none" else [b"a" * 255, b"b" * 600, b"", b"c" * 9]
    body = matroska.block(1, 7, frames, lacing)
    data = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 100) + matroska.element(matroska.SIMPLE_BLOCK, body)))
    media = matroska.parse(data)
    assert [data[at : at + n] for _, _, at, n in media.packets] == frames and media.packets[0][:2] == (1, 107)


def test_matroska_column(spark):
    rows = [(1, None), (2, ""), (3, "é" * 70_001), (4, "same"), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = matroska.media_digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        t = (dict(rows)[r.doc_id] or "").encode()
        payload = t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({r[4:] for r in got if r.doc_id in (4, 5)}) == 1
    data = matroska.mux(b"".join(bytes([i % 251]) for i in range(100_000)))
    media = matroska.parse(data)
    assert {c for *_, c in media.cues} == set(media.clusters) and [t for _, t, _, _ in media.packets] == list(range(0, 100_000, 2048))
    table = matroska.packet_table(matroska.media_column(df.where("doc_id = 3"))).orderBy("packet").collect()
    assert sum(r["size"] for r in table) == 140_032
    unknown = data[:4] and matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.uint(matroska.TIMESTAMP, 3) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, 0, [b"abc"])) + matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 9) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, 0, [b"de"])))
    assert [(t, n) for _, t, _, n in matroska.parse(unknown).packets] == [(3, 3), (9, 2)]
    with pytest.raises(ValueError):
        matroska.parse(data[:-5])
    assert matroska.media_digests(df.limit(0)).count() == 0
    damaged = spark.createDataFrame([(1, bytearray(data[:-5])), (2, bytearray(data)), (3, None), (4, bytearray(b"\x00junk"))], "doc_id long, media binary")
    got = {r.doc_id: r for r in matroska.packet_table(damaged).collect()}
    assert got.keys() == {1, 2, 4} and got[1].error and got[4].error and got[1].packet is None and got[2].error is None
    positions = matroska.element(matroska.CUE_POSITIONS, matroska.uint(matroska.CUE_TRACK, 1))
    cues = matroska.element(matroska.CUES, matroska.element(matroska.CUE_POINT, matroska.uint(matroska.CUE_TIME, 5) + positions))
    assert matroska.parse(matroska.element(matroska.SEGMENT, cues)).cues == []


def test_pipeline_against_plain_steps(spark):
    """run() holds what each stage keeps, judged from its own input by the operators' rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    left = docs.where(~F.col("doc_id").isin(list(toxic)))
    kept = {r.component_id for r in simhash.near_duplicates(left).collect()}
    left = left.where(F.col("doc_id").isin(list(kept)))
    leaked = {r.doc_id for r in decontaminate.contained_items(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    left = left.where(~F.col("doc_id").isin(list(leaked)))
    want = sorted(r.doc_id for r in mixing.mix(left).collect())
    got = corpus_pipeline.run(spark, SF)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == want
    assert leaked and len(kept) < docs.count() - len(toxic)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (2, "", "en", "a", 0), (None, "some words that stand here alone", "en", "b", 5), (9, "y " * 30_000, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("documents", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "an item of six words here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs.withColumn("score", F.lit("clash")), folder)
            assert out.columns == [*docs.columns, "score"], stage
            out.collect()
        assert corpus_pipeline.run(spark, folder).count() <= 10
