import numpy as np
import pytest

from tessella.operators import packed
from tessella.plans import recognition
from tessella.sources import images
from tessella.streaming.frames import apply_to_stream


def test_network_learns_made_up_glyphs(spark):
    model, accuracy = recognition.train(images.synthetic_glyphs(spark, "0123AB", 40), hidden=(32,), epochs=40, rate=0.05)
    assert accuracy > 0.8 and model.classes == list("0123AB")


def test_analysis_reports(spark):
    a = np.full((200, 400), 200, np.uint8)
    a[80:130, 60:240] = 240
    for i in range(7):
        a[90:120, 72 + i * 23 : 80 + i * 23] = 30
    df = spark.createDataFrame([(1, 200, 400, bytearray(a.tobytes())), (2, 200, 400, bytearray(b"\x80" * 80_000))], packed.PACKED)
    model = recognition.default_model(spark, 4, 5)
    row = {r.image_id: r for r in recognition.analyze(df, model).collect()}
    assert row[1].n_chars == 7 == len(row[1].raw_text) and f"Character OCR result = {row[1].raw_text}" in row[1].summary
    assert row[2].n_chars == 0 and "skipped" in row[2].summary
    first = {r.image_id: r for r in recognition.recognize(df, model, True).collect()}
    assert first[1].formatted_text[3] == "-" and first[2].raw_text == "" and first[2].candidates == 0


def test_evaluation(spark):
    labels = spark.createDataFrame([("a", "X1"), ("b", "Y2")], "filename string, expected string")
    got = spark.createDataFrame([("a", "X1"), ("b", "ZZ")], "filename string, predicted string")
    assert tuple(recognition.evaluate(got, labels).first()) == (2, 1)
    with pytest.raises(Exception, match="no result for b"):
        recognition.evaluate(got.where("filename = 'a'"), labels).collect()


def test_stream(spark, tmp_path):
    rows = [(i, 2, 2, bytearray([i, 0, 255, 9])) for i in range(5)]
    spark.createDataFrame(rows, packed.PACKED).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packed.PACKED).parquet(str(tmp_path / "in"))
    q = apply_to_stream(stream, packed.components, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).select("image_id").distinct().count() == 5


def test_stage_files(spark, tmp_path):
    from tessella.plans import demos

    df = spark.createDataFrame([(1, 40, 60, bytearray(np.random.default_rng(0).integers(0, 256, 2400, np.uint8).tobytes()))], packed.PACKED)
    paths = demos.write_stages(demos.preprocess_stages(df).union(demos.detection_stages(df)), f"file://{tmp_path}").collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"1_{s}.png" for s in ("detection_candidates", "detection_enhanced", "preprocess_binary", "preprocess_blurred", "preprocess_enhanced", "preprocess_gray", "preprocess_strip")]
    assert len(paths) == 7 and images.read_images(spark, str(tmp_path / "1_preprocess_strip.png")).first().w == 4 * 60 + 3 * 4
