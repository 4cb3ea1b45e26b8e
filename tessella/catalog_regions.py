"""More queries: predicates, metrics, rankings and text over components, glyphs and tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.catalog import _BLEND, _CC, _KNN, _PAIRS, _TPL, _VEC, _cc, _peaks, _queries_and_all, query
from tessella.functions import text as T
from tessella.operators import classify, kernels, packed, plates, reading, segmentation
from tessella.operators import relational as R
from tessella.sources import carriers as C
from tessella.sources import images

_STATS = f"{C.HEAT_SQL}, {_CC}, k AS (SELECT image_id, CAST(label AS INTEGER) AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY 1, 2)"


def _components(s, d):
    return packed.components(C.heat_packed(s, d))


@query("p15_plate_score", f"WITH RECURSIVE {_STATS} SELECT image_id, label, round(exp(-power(width::DOUBLE / height - 3.5, 2) / 4.5) * least(1, greatest(0, (area::DOUBLE / (width * height) - 0.3) / 0.7)), 9) AS score FROM k")
def p15(s, d):
    c = _components(s, d)
    return c.select("image_id", "label", F.round(R.plate_score(F.col("width") / F.col("height"), F.col("area") / (F.col("width") * F.col("height")), F.lit(0.5)), 9).alias("score"))


@query("p16_region_score", f"WITH RECURSIVE {_STATS}, m AS (SELECT image_id, count(*) AS n FROM k GROUP BY 1) SELECT image_id, n, round(CASE WHEN n BETWEEN 5 AND 8 THEN 0.5 + 0.1 * (n - 5) WHEN n BETWEEN 9 AND 10 THEN 0.35 ELSE least(0.3, 0.05 * n) END::DOUBLE, 9) AS count_score FROM m")
def p16(s, d):
    n = F.col("n")
    score = F.when(n.between(5, 8), 0.5 + 0.1 * (n - 5)).when(n.between(9, 10), F.lit(0.35)).otherwise(F.least(F.lit(0.3), 0.05 * n))
    return _components(s, d).groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", "n", F.round(score, 9).alias("count_score"))


@query("f2_character_geometry", f"WITH RECURSIVE {_STATS} SELECT image_id, label FROM k WHERE height / 31.0 BETWEEN 0.05 AND 0.95 AND width / 24.0 BETWEEN 0.015 AND 0.28 AND area / 744.0 BETWEEN 0.001 AND 0.18 AND area::DOUBLE / (width * height) BETWEEN 0.08 AND 1 AND NOT (x <= 1 OR y <= 1 OR x + width >= 24 - 1 OR y + height >= 31 - 1)")
def f2(s, d):
    c = _components(s, d)
    inside = F.least("x", "y", 24 - F.col("x") - F.col("width"), 31 - F.col("y") - F.col("height")) > 1
    ratio = (F.col("height") / 31).between(0.05, 0.95) & (F.col("width") / 24).between(0.015, 0.28) & (F.col("area") / 744).between(0.001, 0.18)
    return c.where(inside & ratio & (F.col("area") / (F.col("width") * F.col("height"))).between(0.08, 1.0)).select("image_id", "label")


@query("f3_prune_anchor_outliers", f"WITH RECURSIVE {_STATS}, m AS (SELECT image_id, count(*) AS n, median(width) AS mw, median(area) AS ma FROM k GROUP BY 1) SELECT image_id, label FROM k JOIN m USING (image_id) WHERE NOT (n >= 3 AND width < 0.45::DOUBLE * mw AND area < 0.40::DOUBLE * ma)")
def f3(s, d):
    w = Window.partitionBy("image_id")
    c = _components(s, d).withColumn("n", F.count("*").over(w)).withColumn("mw", F.median("width").over(w)).withColumn("ma", F.median("area").over(w))
    return c.where(~((F.col("n") >= 3) & (F.col("width") < 0.45 * F.col("mw")) & (F.col("area") < 0.40 * F.col("ma")))).select("image_id", "label")


@query("f4_suppress_dense_lines", f"WITH {C.HEAT_SQL}, r AS (SELECT *, count(*) FILTER (WHERE v > 0) OVER (PARTITION BY image_id, y) AS n FROM heat), r2 AS (SELECT image_id, y, x, CASE WHEN n > 0.6 * 24 THEN 0 ELSE v END AS v FROM r), c AS (SELECT *, count(*) FILTER (WHERE v > 0) OVER (PARTITION BY image_id, x) AS n FROM r2) SELECT image_id, y, x, CASE WHEN n > 0.5 * 31 THEN 0 ELSE v END AS v FROM c")
def f4(s, d):
    def kept(df, line, most):
        n = F.sum((F.col("v") > 0).cast("int")).over(Window.partitionBy("image_id", line))
        return df.withColumn("n", n).withColumn("v", F.when(F.col("n") > most, 0).otherwise(F.col("v"))).drop("n")

    return kept(kept(C.heat(s, d), "y", 0.6 * 24), "x", 0.5 * 31).select("image_id", "y", "x", "v")


@query("f12_touches_border", f"WITH RECURSIVE {_STATS} SELECT image_id, label, x <= 2 OR y <= 2 OR x + width >= 22 OR y + height >= 29 AS touches FROM k")
def f12(s, d):
    touches = (F.col("x") <= 2) | (F.col("y") <= 2) | (F.col("x") + F.col("width") >= 22) | (F.col("y") + F.col("height") >= 29)
    return _components(s, d).select("image_id", "label", touches.alias("touches"))


@query("j4_interval_overlap", f"WITH RECURSIVE {_STATS} SELECT a.image_id, a.label AS a, b.label AS b, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS shared FROM k a JOIN k b ON a.image_id = b.image_id AND a.label < b.label AND a.x < b.x + b.width AND b.x < a.x + a.width")
def j4(s, d):
    c = _components(s, d)
    a, b = c.alias("a"), c.alias("b")
    on = F.expr("a.image_id = b.image_id and a.label < b.label and a.x < b.x + b.width and b.x < a.x + a.width")
    return a.join(b, on).select(F.col("a.image_id").alias("image_id"), F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.expr("least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)").alias("shared"))


@query("j10_box_density", f"WITH RECURSIVE {_STATS} SELECT k.image_id, k.label, avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS density FROM k JOIN heat h ON h.image_id = k.image_id AND h.x >= k.x AND h.x < k.x + k.width AND h.y >= k.y AND h.y < k.y + k.height GROUP BY 1, 2")
def j10(s, d):
    cells = C.heat(s, d)
    c, h = _components(s, d).alias("c"), cells.alias("h")
    on = F.expr("c.image_id = h.image_id and h.x >= c.x and h.x < c.x + c.width and h.y >= c.y and h.y < c.y + c.height")
    return c.join(h, on).groupBy(F.col("c.image_id").alias("image_id"), F.col("c.label").alias("label")).agg(F.avg((F.col("h.v") > 0).cast("int")).alias("density"))


@query("a9_glyph_shape_metrics", f"WITH {C.GLYPH8_SQL}, r AS (SELECT image_id, y, count(*) FILTER (WHERE v > 127) AS n FROM glyph8 GROUP BY 1, 2) SELECT image_id, sum(n) FILTER (WHERE y < 2)::DOUBLE / greatest(1, sum(n)) AS top_fraction, sum(n) FILTER (WHERE y >= 6)::DOUBLE / greatest(1, sum(n)) AS bottom_fraction, max(n) FILTER (WHERE y < 2) AS top_row_max, max(n) FILTER (WHERE y >= 6) AS bottom_row_max FROM r GROUP BY 1")
def a9(s, d):
    rows = C.glyph8(s, d).groupBy("image_id", "y").agg(F.count_if(F.col("v") > 127).alias("n"))
    top, low = F.when(F.col("y") < 2, F.col("n")), F.when(F.col("y") >= 6, F.col("n"))
    total = F.greatest(F.lit(1), F.sum("n"))
    return rows.groupBy("image_id").agg((F.sum(top) / total).alias("top_fraction"), (F.sum(low) / total).alias("bottom_fraction"), F.max(top).alias("top_row_max"), F.max(low).alias("bottom_row_max"))


@query("a8_foreground_metrics", f"WITH {C.GLYPH8_SQL} SELECT image_id, max(x) - min(x) + 1 AS width, count(*) AS area FROM glyph8 WHERE v > 127 GROUP BY 1")
def a8(s, d):
    return C.glyph8(s, d).where("v > 127").groupBy("image_id").agg((F.max("x") - F.min("x") + 1).alias("width"), F.count("*").alias("area"))


@query("a13_cross_entropy", f"WITH {C.GLYPH8_SQL}, {_VEC}, {_PAIRS}, {_TPL} SELECT round(avg(-ln(greatest(p, 1e-8))), 6) AS loss, count(*) AS n FROM tpl JOIN vec USING (image_id, label)")
def a13(s, d):
    q, t = _queries_and_all(s, d)
    return classify.templates(q, t).join(q.select("image_id", "label"), ["image_id", "label"]).agg(F.round(F.avg(-F.log(F.greatest("p", F.lit(1e-8)))), 6).alias("loss"), F.count("*").alias("n"))


@query("a15_accuracy", f"WITH {C.GLYPH8_SQL}, {_VEC}, {_PAIRS}, {_KNN}, b AS (SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, label) AS r FROM knn) WHERE r = 1) SELECT count(*) AS n, count(*) FILTER (WHERE b.label <> vec.label) AS wrong FROM b JOIN vec USING (image_id)")
def a15(s, d):
    q, t = _queries_and_all(s, d)
    both = R.top_class(classify.knn(q, t)).select("image_id", F.col("label").alias("got")).join(q, "image_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("got") != F.col("label")).alias("wrong"))


@query("c5_zoning_template", f"WITH {C.GLYPH8_SQL}, zv AS (SELECT image_id, label, list(s ORDER BY zone) AS vec FROM (SELECT image_id, label, y // 2 * 4 + x // 2 AS zone, CAST(count(*) FILTER (WHERE v > 127) AS BIGINT) AS s FROM glyph8 GROUP BY 1, 2, 3) GROUP BY 1, 2), dd AS (SELECT q.image_id, t.label, min(list_sum(list_transform(range(1, 17), lambda i: (q.vec[i] - t.vec[i]) * (q.vec[i] - t.vec[i])))) AS d FROM zv q, zv t WHERE q.image_id % 20 = 0 AND t.image_id <> q.image_id GROUP BY 1, 2) SELECT image_id, label, CAST(d AS BIGINT) AS d FROM dd")
def c5(s, d):
    zone = F.expr("cast(y div 2 as int) * 4 + cast(x div 2 as int)")
    z = C.glyph8(s, d).groupBy("image_id", "label", zone.alias("zone")).agg(F.count_if(F.col("v") > 127).alias("s"))
    v = z.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("zone", "s"))).alias("c")).select("image_id", "label", F.transform("c", lambda c: c["s"]).alias("vec"))
    near = classify.nearest(v.where("image_id % 20 = 0"), v, 1)
    return near.groupBy("image_id", "label").agg(F.min("d").alias("d"))


@query("t4_top_three_classes", f"WITH {C.GLYPH8_SQL}, {_VEC}, {_PAIRS}, {_KNN}, {_TPL}, {_BLEND} SELECT image_id, label, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(p, 9) DESC, label DESC) AS r FROM bl) WHERE r <= 3")
def t4(s, d):
    b = classify.blended_search(*_queries_and_all(s, d))
    order = Window.partitionBy("image_id").orderBy(F.round("p", 9).desc(), F.desc("label"))
    return b.select("image_id", "label", F.row_number().over(order).alias("r")).where("r <= 3")


@query("w14_central_gradient", f"WITH {C.HEAT_SQL} SELECT image_id, y, x, coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v) AS gx FROM heat WINDOW w AS (PARTITION BY image_id, y ORDER BY x)")
def w14(s, d):
    w = Window.partitionBy("image_id", "y").orderBy("x")
    return C.heat(s, d).select("image_id", "y", "x", (F.coalesce(F.lead("v").over(w), "v") - F.coalesce(F.lag("v").over(w), "v")).alias("gx"))


@query("w18_row_split", f"WITH RECURSIVE {_STATS}, g AS (SELECT *, cy - lag(cy) OVER w AS gap FROM k WINDOW w AS (PARTITION BY image_id ORDER BY cy, label)), b AS (SELECT image_id, cy AS cut FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(gap, 9) DESC, cy, label) AS r FROM g WHERE gap >= 0.22 * 31) WHERE r = 1) SELECT k.image_id, k.label, CASE WHEN cut IS NOT NULL AND cy >= cut THEN 1 ELSE 0 END AS row_index FROM k LEFT JOIN b USING (image_id)")
def w18(s, d):
    c = _components(s, d)
    g = c.withColumn("gap", F.col("cy") - F.lag("cy").over(Window.partitionBy("image_id").orderBy("cy", "label"))).where(F.col("gap") >= 0.22 * 31)
    first = Window.partitionBy("image_id").orderBy(F.round("gap", 9).desc(), "cy", "label")
    cut = g.withColumn("r", F.row_number().over(first)).where("r = 1").select("image_id", F.col("cy").alias("cut"))
    return c.join(cut, "image_id", "left").select("image_id", "label", F.when(F.col("cut").isNotNull() & (F.col("cy") >= F.col("cut")), 1).otherwise(0).alias("row_index"))


@query("w20_softmax", f"WITH {C.GLYPH8_SQL}, m AS (SELECT image_id, CAST(label * 8 + y AS INTEGER) AS k, sum(v) / 500.0::DOUBLE AS z FROM glyph8 GROUP BY 1, 2), e AS (SELECT image_id, k, exp(z - max(z) OVER (PARTITION BY image_id)) AS e FROM m) SELECT image_id, k, round(e / sum(e) OVER (PARTITION BY image_id), 9) AS p FROM e")
def w20(s, d):
    m = C.glyph8(s, d).groupBy("image_id", (F.col("label") * 8 + F.col("y")).alias("k")).agg((F.sum("v") / 500.0).alias("z"))
    return R.softmax(m, "z").select("image_id", "k", F.round("p", 9).alias("p"))


@query("u1_mask_union", f"WITH {C.HEAT_SQL}, t AS (SELECT a.image_id, a.y, a.x, a.v, CASE WHEN a.v < CAST(sum(b.v) AS DOUBLE) / count(*) - 5 THEN 255 ELSE 0 END AS dark FROM heat a JOIN heat b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.image_id, a.y, a.x, a.v) SELECT image_id, y, x, greatest(dark, CASE WHEN v > 100 THEN 255 ELSE 0 END) AS v FROM t")
def u1(s, d):
    h = C.heat(s, d)
    dark = R.box_dark(h, 5, 5.0).withColumnRenamed("v", "dark")
    return h.join(dark, ["image_id", "y", "x"]).select("image_id", "y", "x", F.greatest("dark", R.fixed_threshold(F.col("v"), 100)).alias("v"))


@query("u3_class_union", "SELECT DISTINCT label FROM embeddings UNION SELECT DISTINCT quality FROM labels")
def u3(s, d):
    return C.table(s, d, "embeddings").select("label").union(C.table(s, d, "labels").select("quality")).distinct()


@query("u4_wanted_classes", "SELECT label, count(*) AS n FROM embeddings WHERE label IN (SELECT DISTINCT quality FROM labels) GROUP BY 1")
def u4(s, d):
    wanted = C.table(s, d, "labels").select(F.col("quality").alias("label")).distinct()
    return C.table(s, d, "embeddings").join(wanted, "label", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


@query("x6_ocr_result", "SELECT o_orderkey, regexp_extract('Image' || chr(10) || 'Character OCR result = ' || upper(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) || ' end', 'Character OCR result = ([A-Z0-9]+)', 1) AS predicted FROM orders")
def x6(s, d):
    report = F.concat(F.lit("Image\nCharacter OCR result = "), T.compact(F.col("o_orderpriority")), F.lit(" end"))
    return C.table(s, d, "orders").select("o_orderkey", T.ocr_result(report).alias("predicted"))


@query("x5_low_confidence", "SELECT vec_id, CAST(len(list_filter(embedding, lambda c: c::DOUBLE < 0.0)) AS INTEGER) AS n_low, CAST(coalesce(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i]::DOUBLE < 0.0 THEN i - 1 ELSE 0 END)), 0) AS BIGINT) AS index_sum FROM embeddings")
def x5(s, d):
    low = T.low_confidence(F.transform("embedding", lambda c: c.cast("double")), 0.0)
    return C.table(s, d, "embeddings").select("vec_id", low.alias("low")).select("vec_id", F.size("low").alias("n_low"), F.aggregate("low", F.lit(0).cast("long"), lambda a, i: a + i).alias("index_sum"))


@query("g2_preprocess")
def g2(s, d):
    return packed.filtered(C.scene(s, d), packed.preprocessed)


@query("g4_hough_lines", f"WITH RECURSIVE {C.HEAT_SQL}, {_peaks('k::DOUBLE', 10)} SELECT image_id, round(bin - sqrt(31.0 * 31 + 24.0 * 24), 6) AS rho, theta, CAST(votes AS INTEGER) AS votes FROM p")
def g4(s, d):
    def make(_, a):
        return [{"rho": r, "theta": t, "votes": v} for r, t, v in kernels.hough(a, np.arange(0, 180.0))]

    return packed.rows(C.heat_packed(s, d), "image_id long, rho double, theta double, votes int", make).withColumn("rho", F.round("rho", 6))


@query("p10_draw_candidates")
def p10(s, d):
    def make(_, a):
        found = plates.detect(plates.enhance(a))
        out = reading.draw_boxes(a, [(c["x"], c["y"], c["width"], c["height"]) for c in found])
        return [{"h": out.shape[0], "w": out.shape[1], "data": out.tobytes()}]

    return packed.rows(C.scene(s, d), packed.PACKED, make)


@query("p10_draw_boxes", f"WITH RECURSIVE {_STATS}, e AS (SELECT DISTINCT h.image_id, h.y, h.x FROM heat h JOIN k ON h.image_id = k.image_id WHERE (h.x >= k.x AND h.x < k.x + k.width AND (h.y - k.y IN (0, 1) OR k.y + k.height - h.y IN (1, 2))) OR (h.y >= k.y AND h.y < k.y + k.height AND (h.x - k.x IN (0, 1) OR k.x + k.width - h.x IN (1, 2)))) SELECT h.image_id, h.y, h.x, CASE WHEN e.x IS NULL THEN h.v ELSE 0 END AS r, CASE WHEN e.x IS NULL THEN h.v ELSE 255 END AS g, CASE WHEN e.x IS NULL THEN h.v ELSE 0 END AS b FROM heat h LEFT JOIN e USING (image_id, y, x)")
def p10_cells(s, d):
    def make(_, a):
        found = kernels.stats(*kernels.label(a))
        out = reading.draw_boxes(a, [plates.coerce_box(c) for c in found])
        return [{"y": y, "x": x, "r": int(r), "g": int(g), "b": int(b)} for y, line in enumerate(out) for x, (r, g, b) in enumerate(line)]

    return packed.rows(C.heat_packed(s, d), "image_id long, y int, x int, r int, g int, b int", make)


_LARGEST = """st AS (SELECT image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY 1, 2),
best AS (SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area - 0.12::DOUBLE * area * (abs(cx - 3.5) / 8 + abs(cy - 3.5) / 8) DESC, label) AS r FROM st) WHERE r = 1)"""


@query("t8_clean_glyph", f"WITH RECURSIVE {C.GLYPH8_SQL}, {_cc('glyph8', 'v > 127', 8)}, {_LARGEST} SELECT g.image_id, g.y, g.x, CASE WHEN best.label IS NULL THEN 0 ELSE 255 END AS v FROM glyph8 g LEFT JOIN n USING (image_id, y, x) LEFT JOIN best ON best.image_id = g.image_id AND best.label = n.label")
def t8(s, d):
    return packed.filtered_cells(C.packed(C.glyph8(s, d).drop("label")), lambda a: reading.largest_glyph(kernels.threshold(a, 127)))


_FIT = """m AS (SELECT image_id, y, x, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM glyph8),
b AS (SELECT image_id, min(y) AS top, min(x) AS l, max(y) - min(y) AS dh, max(x) - min(x) AS dw FROM m WHERE v > 0 GROUP BY 1),
f AS (SELECT *, CAST(round_even((dh + 1) * k, 0) AS INTEGER) AS h, CAST(round_even((dw + 1) * k, 0) AS INTEGER) AS w FROM (SELECT *, least(32.0::DOUBLE / (dh + 1), 32.0::DOUBLE / (dw + 1)) AS k FROM b)),
p AS (SELECT *, CASE WHEN i = h - 1 THEN dh ELSE i * (dh::DOUBLE / (h - 1)) END AS sy, CASE WHEN j = w - 1 THEN dw ELSE j * (dw::DOUBLE / (w - 1)) END AS sx FROM f CROSS JOIN range(0, 32) a(i) CROSS JOIN range(0, 32) c(j) WHERE i < h AND j < w),
q AS (SELECT *, CAST(floor(sy) AS INTEGER) AS y0, CAST(floor(sx) AS INTEGER) AS x0 FROM p),
o AS (SELECT q.image_id, (32 - h) // 2 + i AS y, (32 - w) // 2 + j AS x, (m1.v * (1 - (sx - x0)) + m2.v * (sx - x0)) * (1 - (sy - y0)) + (m3.v * (1 - (sx - x0)) + m4.v * (sx - x0)) * (sy - y0) AS v FROM q
  JOIN m m1 ON m1.image_id = q.image_id AND m1.y = top + y0 AND m1.x = l + x0 JOIN m m2 ON m2.image_id = q.image_id AND m2.y = top + y0 AND m2.x = l + least(x0 + 1, dw)
  JOIN m m3 ON m3.image_id = q.image_id AND m3.y = top + least(y0 + 1, dh) AND m3.x = l + x0 JOIN m m4 ON m4.image_id = q.image_id AND m4.y = top + least(y0 + 1, dh) AND m4.x = l + least(x0 + 1, dw))"""


@query("g11_normalize_character", f"WITH {C.GLYPH8_SQL}, {_FIT} SELECT u.image_id, CAST(ry AS INTEGER) AS y, CAST(rx AS INTEGER) AS x, CASE WHEN round_even(o.v, 0) > 127 THEN 255 ELSE 0 END AS v FROM (SELECT DISTINCT image_id FROM glyph8) u CROSS JOIN range(0, 32) a(ry) CROSS JOIN range(0, 32) c(rx) LEFT JOIN o ON o.image_id = u.image_id AND o.y = ry AND o.x = rx")
def g11(s, d):
    return packed.filtered_cells(C.packed(C.glyph8(s, d).drop("label")), lambda a: kernels.fit_glyph(kernels.threshold(a, 127)))


_CROSS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)"


@query("p17_cross_element", f"WITH {C.HEAT_SQL} SELECT a.image_id, a.y, a.x, CASE WHEN max(b.v) > 0 THEN 255 ELSE 0 END AS grown, CASE WHEN min(CASE WHEN a.y + dy BETWEEN 0 AND 30 AND a.x + dx BETWEEN 0 AND 23 THEN b.v ELSE 0 END) > 0 THEN 255 ELSE 0 END AS shrunk FROM heat a CROSS JOIN {_CROSS} JOIN heat b ON b.image_id = a.image_id AND b.y = 30 - abs(30 - abs(a.y + dy)) AND b.x = 23 - abs(23 - abs(a.x + dx)) GROUP BY 1, 2, 3")
def p17(s, d):
    def make(_, a):
        grown, shrunk = (kernels.morph(a, kernels.cross(3), most) for most in (True, False))
        return [{"y": y, "x": x, "grown": int(grown[y, x]), "shrunk": int(shrunk[y, x])} for y, x in np.ndindex(a.shape)]

    return packed.rows(C.heat_packed(s, d), "image_id long, y int, x int, grown int, shrunk int", make)


_MERGED = """col AS (SELECT image_id, x FROM heat WHERE v > 100 GROUP BY 1, 2),
run AS (SELECT image_id, min(x) AS a, max(x) + 1 AS b, row_number() OVER (PARTITION BY image_id ORDER BY min(x)) AS i FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id ORDER BY x) AS g FROM col) GROUP BY image_id, g),
fold AS (SELECT image_id, i, a, b FROM run WHERE i = 1
  UNION ALL SELECT r.image_id, r.i, CASE WHEN r.a - f.b <= 2 AND r.b - f.a <= 6 THEN f.a ELSE r.a END, r.b FROM fold f JOIN run r ON r.image_id = f.image_id AND r.i = f.i + 1)"""


@query("w17_merged_runs", f"WITH RECURSIVE {C.HEAT_SQL}, {_MERGED} SELECT image_id, a AS x0, max(b) AS x1 FROM fold GROUP BY 1, 2")
def w17(s, d):
    def make(_, a):
        return [{"x0": int(p), "x1": int(q)} for p, q in segmentation.merged_runs(segmentation.runs((a > 100).any(axis=0)), 10)]

    return packed.rows(C.heat_packed(s, d), "image_id long, x0 int, x1 int", make)


@query("p12_character_strip", f"WITH {C.GLYPH8_SQL} SELECT u.image_id, CAST(ry AS INTEGER) AS y, CAST(rx AS INTEGER) AS x, coalesce(g.v, 245) AS v FROM (SELECT DISTINCT image_id FROM glyph8) u CROSS JOIN range(0, 16) a(ry) CROSS JOIN range(0, 34) c(rx) LEFT JOIN glyph8 g ON g.image_id = u.image_id AND g.y = CASE WHEN rx < 16 THEN ry // 2 WHEN rx >= 24 AND ry BETWEEN 2 AND 13 THEN (ry - 2) // 2 END AND g.x = CASE WHEN rx < 16 THEN rx // 2 WHEN rx >= 24 THEN (rx - 24) // 2 END")
def p12(s, d):
    """A glyph beside its own first six rows and five columns."""
    return packed.filtered_cells(C.packed(C.glyph8(s, d).drop("label")), lambda a: reading.character_strip([a, a[:6, :5]], scale=2)[..., 0])


@query("p13_feature_preview", "WITH e AS (SELECT vec_id AS image_id, unnest(embedding)::FLOAT AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) SELECT image_id, CAST(377 + p AS INTEGER) AS x, CAST(round_even(abs(v) / max(abs(v)) OVER (PARTITION BY image_id) * 112::FLOAT, 0) AS INTEGER) AS height FROM e")
def p13(s, d):
    """Heights of the bars of whole vectors, read from the picture."""
    schema = "image_id long, x int, height int"

    def run(batches):
        for pdf in batches:
            for image_id, vector in zip(pdf.image_id, pdf.vector, strict=True):
                blue = (reading.feature_preview(vector) == (40, 95, 170)).all(axis=2).sum(axis=0)
                yield pd.DataFrame({"image_id": image_id, "x": range(378, 378 + len(vector)), "height": blue[378 : 378 + len(vector)]})

    return C.table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector")).mapInPandas(run, schema)


@query("s9_synthetic_glyphs")
def s9(s, d):
    return images.synthetic_glyphs(s, per_class=20)


@query("e9_analyze_text")
def e9(s, d):
    from tessella.plans import recognition

    return recognition.analyze(C.scene(s, d), recognition.default_model(s))


@query("e10_recognize_text")
def e10(s, d):
    from tessella.plans import recognition

    return recognition.recognize(C.scene(s, d), recognition.default_model(s), plate_format=True)
