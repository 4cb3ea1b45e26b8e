"""Rasters made from the test tables: LONG frames (image_id, y, x, v), packed frames, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_WIDTH = 64
PACKED = "image_id long, h int, w int, data binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def textmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, 64 characters a row, level = code point modulo 256; the last row may be short."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "")).alias("pos", "c"))
    return docs.where("c <> ''").selectExpr("image_id", f"cast(pos div {TEXT_WIDTH} as int) y", f"pos % {TEXT_WIDTH} x", "ascii(c) % 256 v")


def glyph8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 glyphs with a class from embeddings."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("pos", "e"))
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.6) * 212.5))).cast("int")
    return rows.select("image_id", "label", F.expr("cast(pos div 8 as int)").alias("y"), (F.col("pos") % 8).alias("x"), level.alias("v"))


def _heat_cells(events: DataFrame) -> DataFrame:
    cells = events.select(F.col("user_id").alias("image_id"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x"), F.floor("value").alias("f"))
    return cells.groupBy("image_id", "y", "x").agg(F.least(F.lit(255), F.greatest(F.lit(0), F.sum("f"))).cast("int").alias("v"))


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user 31 x 24 cells: day of month and hour, level = sum of whole values, 255 at most."""
    events = table(spark, sf_dir, "events")
    seen = _heat_cells(events)
    every = events.select(F.col("user_id").alias("image_id")).distinct().select("image_id", F.explode(F.expr("sequence(0, 30)")).alias("y")).select("image_id", "y", F.explode(F.expr("sequence(0, 23)")).alias("x"))
    return every.join(seen, ["image_id", "y", "x"], "left").fillna({"v": 0})


def heat_lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero cells of `heat`. They come from the events alone: of `heat` under a filter Spark makes an
    inner join and takes the whole grid, 744 rows a user, for small enough to broadcast."""
    cells = _heat_cells(table(spark, sf_dir, "events"))
    return cells.where("v > 0 and image_id is not null and y is not null and x is not null")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per order line; the order is the image."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.selectExpr("l_orderkey image_id", "l_linenumber x", "cast(l_partkey % 256 as int) r", "cast(l_suppkey % 256 as int) g", "cast(l_orderkey % 256 as int) b")


def _bytes(batches, make):
    """Packed rows (image_id, h, w, data) of the rasters that `make` draws for each row of a batch."""
    import pandas as pd

    for pdf in batches:
        drawn = [make(r) for r in pdf.itertuples(index=False)]
        yield pd.DataFrame({"image_id": pdf["image_id"], "h": [a.shape[0] for a in drawn], "w": [a.shape[1] for a in drawn], "data": [a.tobytes() for a in drawn]})


def packed(long: DataFrame) -> DataFrame:
    """(image_id, h, w, data): row-major bytes of LONG rasters; cells that are absent are 0."""
    cells = F.collect_list(F.struct("y", "x", "v"))
    rows = long.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"), cells.alias("cells"))
    return _densified(rows)


def _densified(rows: DataFrame) -> DataFrame:
    rows = rows.select("image_id", "h", "w", F.transform("cells", lambda c: c["y"].cast("int")).alias("y"), F.transform("cells", lambda c: c["x"].cast("int")).alias("x"), F.transform("cells", lambda c: c["v"].cast("int")).alias("v"))

    def draw(r):
        out = np.zeros((r.h, r.w), np.uint8)
        out[r.y, r.x] = r.v
        return out

    return rows.mapInPandas(lambda batches: _bytes(batches, draw), PACKED)


def heat_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat rasters, packed: the 744 cells at most that a user has are all that is gathered."""
    seen = _heat_cells(table(spark, sf_dir, "events"))
    return _densified(seen.groupBy("image_id").agg(F.lit(31).alias("h"), F.lit(24).alias("w"), F.collect_list(F.struct("y", "x", "v")).alias("cells")))


def text_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as packed rasters of one row, level = code point modulo 256; none for an empty text."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("image_id"), "text")

    def draw(r):
        return (np.frombuffer(r.text.encode("utf-32-le", "surrogatepass"), "<u4") % 256).astype(np.uint8)[None, :]

    return docs.mapInPandas(lambda batches: _bytes(batches, draw), PACKED)


def unpacked(df: DataFrame) -> DataFrame:
    """LONG cells of packed rasters."""
    pairs = F.regexp_extract_all(F.hex("data"), F.lit(".."), F.lit(0))
    cells = df.select("image_id", "w", F.posexplode(pairs).alias("i", "d"))
    return cells.selectExpr("image_id", "cast(i div w as int) y", "cast(i % w as int) x", "cast(conv(d, 16, 10) as int) v")


def draw_scene(key: int, h: int = 100, w: int = 200) -> np.ndarray:
    """A plate of bars on a plain ground, by rule from `key`: every third is turned, every fourth
    has two lines, every fifth is speckled, every seventh is small and bright on dark ground."""
    from tessella.operators import kernels

    rng = np.random.default_rng([17, key])
    unit = h / 100
    bright = key % 7 == 5 and h >= 200
    ph, pw = (round(x * unit * (0.5 if bright else 1)) for x in ((44, 90) if key % 4 == 3 else (25, 90)))
    out = np.full((h, w), 60 if bright else 200, np.uint8)
    y0 = round((15 + key * 5 % 36) * unit)
    x0 = min(w - pw - 5, round((20 + key * 7 % 80) * unit))
    plate = np.full((ph, pw), 240, np.uint8)
    lines = [(0.10, 0.44, 3), (0.54, 0.90, 4)] if key % 4 == 3 else [(0.20, 0.80, 7)]
    for top, low, n in lines:
        pitch = pw / (n + 0.6)
        for i in range(n):
            a = round(pitch * (i + 0.45))
            plate[round(top * ph) : round(low * ph), a : a + max(3, round(pitch * 0.38))] = 30
    out[y0 : y0 + ph, x0 : x0 + pw] = plate
    if key % 3 == 1:
        out = kernels.rotate(out, float(rng.uniform(-6, 6)), int(out[0, 0]))
    if key % 5 == 2:
        out = np.where(rng.random(out.shape) < 0.003, rng.integers(0, 256, out.shape), out).astype(np.uint8)
    return out


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed 100 x 200 scenes, one for each supplier."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("image_id")).repartition(spark.sparkContext.defaultParallelism, "image_id")
    return keys.mapInPandas(lambda batches: _bytes(batches, lambda r: draw_scene(r.image_id)), PACKED)


def large_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed 768 x 1024 scenes, one for each nation."""
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("image_id")).repartition(spark.sparkContext.defaultParallelism, "image_id")
    return keys.mapInPandas(lambda batches: _bytes(batches, lambda r: draw_scene(r.image_id, 768, 1024)), PACKED)


TEXTMAP_SQL = f"""textmap AS (SELECT image_id, CAST((p - 1) // {TEXT_WIDTH} AS INTEGER) AS y, CAST((p - 1) % {TEXT_WIDTH} AS INTEGER) AS x, CAST(unicode(c) % 256 AS INTEGER) AS v
  FROM (SELECT doc_id AS image_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents))"""
GLYPH8_SQL = """glyph8 AS (SELECT image_id, label, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x,
  CAST(least(255, greatest(0, floor((e::DOUBLE + 0.6) * 212.5))) AS INTEGER) AS v
  FROM (SELECT vec_id AS image_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
HEAT_SQL = """heat AS (SELECT u.image_id, CAST(d.y AS INTEGER) AS y, CAST(h.x AS INTEGER) AS x, CAST(coalesce(s.v, 0) AS INTEGER) AS v
  FROM (SELECT DISTINCT user_id AS image_id FROM events) u CROSS JOIN range(0, 31) d(y) CROSS JOIN range(0, 24) h(x)
  LEFT JOIN (SELECT user_id AS image_id, day(ts) - 1 AS y, hour(ts) AS x, least(255, greatest(0, sum(floor(value)))) AS v FROM events GROUP BY 1, 2, 3) s
  ON s.image_id = u.image_id AND s.y = d.y AND s.x = h.x)"""
RGB_SQL = """rgb AS (SELECT l_orderkey AS image_id, l_linenumber AS x, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_orderkey % 256 AS INTEGER) AS b FROM lineitem)"""
