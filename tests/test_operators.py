import numpy as np
import pytest

from tessella import catalog
from tessella.operators import classify, kernels as K, models, packed, plates, reading, segmentation as S
from tessella.operators import relational as R
from tessella.sources import carriers, images


def scene():
    a = np.full((200, 400), 200, np.uint8)
    a[80:130, 60:240] = 240
    for i in range(7):
        a[90:120, 72 + i * 23 : 80 + i * 23] = 30
    return a


def long(spark, a, image_id=1):
    return spark.createDataFrame([(image_id, y, x, int(v)) for y, row in enumerate(a) for x, v in enumerate(row)], "image_id long, y int, x int, v int")


def grid(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def test_luma(spark):
    df = spark.createDataFrame([(1, 0, 255, 0, 0), (1, 1, 0, 255, 0), (1, 2, 0, 0, 255), (1, 3, 255, 255, 255)], "image_id long, x int, r int, g int, b int")
    assert [r.v for r in R.grayscale(df).orderBy("x").collect()] == [76, 150, 29, 255]


def test_threshold_and_otsu(spark):
    a = np.array([[0, 100], [128, 200]], np.uint8)
    assert K.threshold(a, 128).tolist() == [[0, 0], [0, 255]] and K.threshold(a, 128, True).tolist() == [[255, 255], [255, 0]]
    two = np.full((20, 20), 200, np.uint8)
    two[:10] = 50
    assert 50 <= K.otsu(two) < 200 and K.otsu(np.full((4, 4), 9, np.uint8)) == 0
    both = long(spark, two).union(long(spark, np.full((4, 4), 9, np.uint8), 2))
    assert {r.image_id: r.threshold for r in R.otsu(both).collect()} == {1: K.otsu(two), 2: 0}


def test_filters():
    salt = np.full((9, 9), 100, np.uint8)
    salt[4, 4] = 255
    assert K.median(salt, 3)[4, 4] == 100
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 255
    gx, gy = K.gradient(step)
    assert gx[10, 10] > 500 and abs(gy[10, 10]) < 1
    assert (K.clahe(np.full((40, 40), 77, np.uint8)) == K.clahe(np.full((40, 40), 77, np.uint8))[0, 0]).all()
    ramp = np.tile(np.linspace(80, 120, 64).astype(np.uint8), (64, 1))
    assert np.ptp(K.clahe(ramp, (2, 2), 4.0)) > np.ptp(ramp)
    for bad in (2, 4, 0, -1):
        with pytest.raises(ValueError):
            K.gaussian(bad, 1.0)


@pytest.mark.parametrize("shape", [(9, 14), (1, 6), (6, 1)])
def test_windows_equal_kernels(spark, shape):
    a = (np.random.default_rng(3).random(shape) < 0.4).astype(np.uint8) * 200
    df = long(spark, a)
    if min(shape) > 2:
        assert (grid(R.dilate(df, 3, 5), shape) == K.dilate(a, 3, 5)).all()
    assert (grid(R.erode(df, 3, 3), shape) == K.erode(a, 3, 3)).all()
    assert (grid(R.box_dark(df, 5, 15.0), shape) == K.box_dark(a, 5, 15.0)).all()


def test_components():
    for shape, cells, eight, four in (((5, 5), [(1, 1), (2, 2)], 1, 2), ((5, 7), [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2)], 1, 1)):
        a = np.zeros(shape, np.uint8)
        for c in cells:
            a[c] = 255
        assert K.label(a, 8)[1] == eight and K.label(a, 4)[1] == four
    a = np.zeros((10, 10), np.uint8)
    a[3:7, 3:7] = 255
    (c,) = K.stats(*K.label(a))
    assert (c["x"], c["y"], c["width"], c["height"], c["area"], c["cx"]) == (3, 3, 4, 4, 16, 4.5)
    rng = np.random.default_rng(0)
    for _ in range(40):
        a = (rng.random((12, 15)) < 0.5).astype(np.uint8)
        for conn in (4, 8):
            want, n = np.zeros(a.shape, int), 0
            for y, x in zip(*np.nonzero(a), strict=True):
                if not want[y, x]:
                    n += 1
                    todo = [(y, x)]
                    while todo:
                        i, j = todo.pop()
                        if 0 <= i < 12 and 0 <= j < 15 and a[i, j] and not want[i, j]:
                            want[i, j] = n
                            todo += [(i + p, j + q) for p in (-1, 0, 1) for q in (-1, 0, 1) if conn == 8 or not (p and q)]
            got, m = K.label(a, conn)
            assert m == n and (got == want).all()
    with pytest.raises(ValueError):
        K.label(a, 6)


def test_geometry():
    a = np.full((10, 10), 20, np.uint8)
    a[:4, :4] = 100
    c = K.crop(a, (0, 0, 4, 4), 0.5)
    assert c.shape == (8, 8) and c[0, 0] == 255 and c[2, 2] == 100
    r = K.resize(np.array([[0, 10], [20, 30]], np.uint8), (5, 5))
    assert [r[0, 0], r[0, 4], r[4, 0], r[4, 4]] == [0, 10, 20, 30]
    line = np.zeros((60, 120), np.uint8)
    line[30, 10:110] = 255
    ((rho, theta, votes),) = K.hough(line, np.arange(85, 96.0), 1)
    assert abs(theta - 90) < 1e-9 and votes >= 90
    slope = np.zeros((80, 160), np.uint8)
    for x in range(20, 140):
        slope[round(30 + 0.1 * (x - 20)), x] = 255
    assert abs(K.skew(slope) - 5.7) <= 1 and K.skew(np.zeros((8, 8), np.uint8)) == 0


def test_plate(spark):
    enhanced = plates.enhance(scene())
    found = plates.detect(enhanced)
    assert found and 30 <= found[0]["x"] <= 80 and 60 <= found[0]["y"] <= 100 and found[0]["score"] > 0.05
    assert plates.detect(np.full((200, 400), 128, np.uint8)) == []
    best = plates.choose_region(enhanced, found)
    assert len(best["chars"]) == 7 and abs(best["angle"]) <= 15
    df = spark.createDataFrame([(1, 200, 400, bytearray(scene().tobytes()))], packed.PACKED)
    row = packed.read_plates(df).first()
    assert row.n_chars == 7 and len(row.features) == 7 and len(row.features[0]) == 340


def test_segmentation():
    plate = np.full((80, 240), 230, np.uint8)
    plate[8:72, 8:232] = 245
    x, gap = 31, 11
    for i in range(7):
        plate[16 + i % 2 : 64 + i % 2, x : x + 16] = 25
        x += 16 + gap
    chars = S.segment(plate)
    assert len(chars) == 7 and [c["x"] for c in chars] == sorted(c["x"] for c in chars) and all(c["glyph"].shape == (32, 32) for c in chars)
    assert S.segment(np.full((80, 240), 230, np.uint8)) == []


def test_features():
    assert len(K.hog(np.zeros((32, 32), np.uint8))) == 324 and not K.hog(np.zeros((32, 32), np.uint8)).any()
    a = np.zeros((8, 8), np.uint8)
    a[:4, :4] = 255
    assert K.zoning(a, (2, 2)).tolist() == [1, 0, 0, 0]
    with pytest.raises(ValueError):
        K.zoning(a, (0, 2))


def test_classifiers(spark, tmp_path):
    train = spark.createDataFrame([(0, 0, [0, 0]), (1, 0, [0, 1]), (2, 1, [5, 5]), (3, 1, [6, 5])], "image_id long, label int, vec array<long>")
    q = spark.createDataFrame([(10, [0, 1]), (11, [5, 6])], "image_id long, vec array<long>")
    assert {r.image_id: r.label for r in R.top_class(classify.knn(q, train, 1)).collect()} == {10: 0, 11: 1}
    assert all(abs(sum(r.p for r in classify.knn(q, train, 3).where(f"image_id = {i}").collect()) - 1) < 1e-12 for i in (10, 11))
    model = classify.Mlp((8,), 0.05, 200, 4, 0.0, 7).fit([[0, 0], [0, 1], [5, 5], [6, 5]], list("AABB"))
    assert model.losses[-1] < model.losses[0] and [model.classes[k] for k in model.proba([[0, 0], [6, 6]]).argmax(axis=1)] == ["A", "B"]
    models.save_mlp(spark, model, str(tmp_path / "m"))
    again, meta = models.load_mlp(spark, str(tmp_path / "m"))
    assert np.allclose(again.proba([[1, 2]]), model.proba([[1, 2]])) and meta["model_type"] == "mlp"
    with pytest.raises(ValueError):
        models.save_mlp(spark, classify.Mlp(), str(tmp_path / "n"))
    with pytest.raises(ValueError):
        classify.knn(q, train, 0)


def test_reading():
    got = reading.postprocess(list("3OA12S4"), [0.9, 0.9, 0.8, 0.7, 0.7, 0.4, 0.9])
    assert (got["corrected_text"], got["formatted_text"], got["low_confidence_indices"]) == ("30A1254", "30A-1254", [5])
    glyph = np.zeros((32, 32), np.uint8)
    assert reading.refine(["2", "I"], [{}, {"1": 0.1, "I": 0.9}], [glyph, glyph]) == ["2", "1"]
    assert reading.top_k({"A": 0.4, "B": 0.4, "C": 0.2}, 2) == [("B", 0.4), ("A", 0.4)]
    assert reading.character_strip([]) is None and reading.draw_boxes(np.zeros((9, 9), np.uint8), [(-2, -2, 20, 20)])[0, 0].tolist() == [0, 255, 0]


def test_images(spark, tmp_path):
    rgb = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png(rgb))
    row = images.read_images(spark, str(tmp_path / "in")).first()
    assert (row.h, row.w, row.channels, bytes(row.data)) == (5, 7, 3, rgb.tobytes())
    df = spark.createDataFrame([("b", 5, 7, 3, bytearray(rgb.tobytes()))], images.PACKED)
    out = images.write_images(df, f"file://{tmp_path}/out").first()
    assert (tmp_path / "out" / "b.png").read_bytes() == images.png(rgb) and out.path.endswith("b.png")
    assert images.side_by_side([rgb, rgb[:3]]).shape == (5, 18, 3)
    (tmp_path / "l.json").write_text('{"a.png": "30a-123.45"}')
    assert images.read_labels(spark, str(tmp_path / "l.json")).first().expected == "30A12345"
    import struct

    pix = np.zeros((4, 28, 28), np.uint8)
    pix[:, 5:20, 8:12] = 255
    (tmp_path / "i").write_bytes(struct.pack(">IIII", 2051, 4, 28, 28) + pix.tobytes())
    (tmp_path / "k").write_bytes(struct.pack(">II", 2049, 4) + bytes([0, 0, 1, 1]))
    (tmp_path / "map").write_text("0 48\n1 65\n")
    got = images.emnist_rows(spark, str(tmp_path / "i"), str(tmp_path / "k"), str(tmp_path / "map"), "0A").collect()
    assert sorted(r.label for r in got) == ["0", "0", "A", "A"] and all(len(r.data) == 1024 for r in got)
    with pytest.raises(ValueError):
        images.parse_idx(struct.pack(">II", 2049, 5) + b"\0")
    made = images.synthetic_glyphs(spark, "01A", 3, 123).collect()
    assert len(made) == 9 and max(made[0].data) == 255 and sorted({r.label for r in made}) == ["0", "1", "A"]


def test_packing(spark):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    df = carriers.packed(long(spark, a))
    assert bytes(df.first().data) == a.tobytes() and (grid(carriers.unpacked(df), a.shape) == a).all()


def test_elements():
    a = np.zeros((10, 10), np.uint8)
    a[5, 5] = 255
    grown = K.morph(a, K.cross(3), True)
    assert (grown > 0).sum() == 5 and (K.morph(grown, K.cross(3), False) == a).all()
    rng = np.random.default_rng(0)
    for _ in range(5):
        b = (rng.random((9, 12)) < 0.4).astype(np.uint8)
        for h, w in ((3, 3), (1, 5), (5, 3)):
            assert (K.morph(b, K.rect(h, w), True) == K.dilate(b, h, w)).all()
            assert (K.morph(b, K.rect(h, w), False) == K.erode(b, h, w)).all()
    for bad in (1, 2, 4):
        with pytest.raises(ValueError):
            K.cross(bad)


def odd_events(spark, folder):
    """Two users, and rows without user, time or value, of cells that are negative, zero and over 255."""
    rows = [(1, "2024-01-01 00:10:00", 3.5), (1, "2024-01-01 00:20:00", 400.0), (1, "2024-01-31 23:00:00", 0.5), (1, "2024-01-02 01:00:00", 7.0), (1, "2024-01-02 02:00:00", 1.0), (2, "2024-02-03 05:00:00", -4.0), (2, "2024-02-04 06:00:00", None), (2, "2024-02-05 07:00:00", 9.0), (2, None, 9.0), (None, "2024-01-01 00:10:00", 9.0)]
    events = spark.createDataFrame(rows, "user_id long, ts string, value double")
    events.selectExpr("user_id", "cast(ts as timestamp_ntz) ts", "value").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_lit_heat_is_heat_without_zeros(spark, tmp_path):
    sf = odd_events(spark, tmp_path)
    lit, whole = carriers.heat_lit(spark, sf), carriers.heat(spark, sf)
    assert sorted(map(tuple, lit.collect())) == sorted(map(tuple, whole.where("v > 0").select(lit.columns).collect()))
    assert lit.count() == 4 and whole.where("image_id is not null").count() == 2 * 744


@pytest.mark.parametrize("name", ["a3_hough_votes", "w16_row_runs"])
def test_no_grid_is_broadcast(spark, tmp_path, name):
    sf = odd_events(spark, tmp_path)
    got = catalog.QUERIES[name](spark, sf)
    got.collect()
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
