"""Queries over the test tables for the raster operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.config import Detection
from tessella.functions import text as T
from tessella.operators import classify, kernels, packed
from tessella.operators import relational as R
from tessella.sources import carriers as C

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_HIST = "h AS (SELECT image_id, v, count(*) AS cnt FROM textmap GROUP BY 1, 2)"
_CDF = _HIST + ", c AS (SELECT *, sum(cnt) OVER (PARTITION BY image_id ORDER BY v) AS cum FROM h)"


@query("p1_grayscale", f"WITH {C.RGB_SQL} SELECT image_id, x, CAST(least(255, round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0)) AS INTEGER) AS v FROM rgb")
def p1(s, d):
    return R.grayscale(C.rgb(s, d)).select("image_id", "x", "v")


@query("p2_fixed_threshold", f"WITH {C.HEAT_SQL} SELECT image_id, y, x, CASE WHEN v > 100 THEN 255 ELSE 0 END AS lit, CASE WHEN v <= 100 THEN 255 ELSE 0 END AS dark FROM heat")
def p2(s, d):
    return C.heat(s, d).select("image_id", "y", "x", R.fixed_threshold(F.col("v"), 100).alias("lit"), R.fixed_threshold(F.col("v"), 100, True).alias("dark"))


@query("p4_intensity_scaling", f"WITH {C.HEAT_SQL} SELECT image_id, y, x, CASE WHEN m > 0 THEN CAST(floor(v * (255.0::DOUBLE / m)) AS INTEGER) ELSE 0 END AS scaled FROM (SELECT *, max(v) OVER (PARTITION BY image_id) AS m FROM heat)")
def p4(s, d):
    return R.scaled_by_peak(C.heat(s, d)).select("image_id", "y", "x", "scaled")


@query("p5_crop_with_padding", f"WITH {C.HEAT_SQL}, g AS (SELECT image_id, ty, tx FROM (SELECT DISTINCT image_id FROM heat) CROSS JOIN range(0, 24) a(ty) CROSS JOIN range(0, 14) b(tx)) SELECT g.image_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, coalesce(v, 255) AS v FROM g LEFT JOIN heat h ON h.image_id = g.image_id AND h.y = ty + 16 AND h.x = tx + 14")
def p5(s, d):
    return R.crop(C.heat(s, d), 16, 20, 10, 16, 0.25)


_RESIZE = """g AS (SELECT image_id, ty, tx, ty * 30.0::DOUBLE / 15 AS sy, tx * 23.0::DOUBLE / 11 AS sx FROM (SELECT DISTINCT image_id FROM heat) CROSS JOIN range(0, 16) a(ty) CROSS JOIN range(0, 12) b(tx)),
f AS (SELECT *, CAST(floor(sy) AS INTEGER) AS y0, CAST(floor(sx) AS INTEGER) AS x0 FROM g)
SELECT f.image_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, CAST(round_even((a.v * (1 - (sx - x0)) + b.v * (sx - x0)) * (1 - (sy - y0)) + (c.v * (1 - (sx - x0)) + e.v * (sx - x0)) * (sy - y0), 0) AS INTEGER) AS v
FROM f JOIN heat a ON a.image_id = f.image_id AND a.y = y0 AND a.x = x0 JOIN heat b ON b.image_id = f.image_id AND b.y = y0 AND b.x = least(x0 + 1, 23)
JOIN heat c ON c.image_id = f.image_id AND c.y = least(y0 + 1, 30) AND c.x = x0 JOIN heat e ON e.image_id = f.image_id AND e.y = least(y0 + 1, 30) AND e.x = least(x0 + 1, 23)"""


@query("p8_resize_bilinear", f"WITH {C.HEAT_SQL}, {_RESIZE}")
def p8(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), lambda a: kernels.resize(a, (16, 12)))


_ROTATE = """t AS (SELECT cos(radians(7.5::DOUBLE)) AS c, sin(radians(7.5::DOUBLE)) AS s),
g AS (SELECT image_id, y, x, 11.5 + c * (x - 11.5) + s * (y - 15) AS sx, 15 - s * (x - 11.5) + c * (y - 15) AS sy FROM heat, t),
f AS (SELECT *, CAST(least(greatest(floor(sy), 0), 30) AS INTEGER) AS y0, CAST(least(greatest(floor(sx), 0), 23) AS INTEGER) AS x0 FROM g WHERE sx >= 0 AND sy >= 0 AND sx <= 23 AND sy <= 30)
SELECT g.image_id, g.y, g.x, CAST(coalesce(round_even((a.v * (1 - (f.sx - x0)) + b.v * (f.sx - x0)) * (1 - (f.sy - y0)) + (k.v * (1 - (f.sx - x0)) + e.v * (f.sx - x0)) * (f.sy - y0), 0), 255) AS INTEGER) AS v
FROM g LEFT JOIN f ON f.image_id = g.image_id AND f.y = g.y AND f.x = g.x LEFT JOIN heat a ON a.image_id = f.image_id AND a.y = y0 AND a.x = x0 LEFT JOIN heat b ON b.image_id = f.image_id AND b.y = y0 AND b.x = least(x0 + 1, 23)
LEFT JOIN heat k ON k.image_id = f.image_id AND k.y = least(y0 + 1, 30) AND k.x = x0 LEFT JOIN heat e ON e.image_id = f.image_id AND e.y = least(y0 + 1, 30) AND e.x = least(x0 + 1, 23)"""


@query("p7_rotate", f"WITH {C.HEAT_SQL}, {_ROTATE}")
def p7(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), lambda a: kernels.rotate(a, 7.5))


@query("a1_histogram", f"WITH {C.TEXTMAP_SQL}, {_HIST} SELECT image_id, v, cnt FROM h")
def a1(s, d):
    return packed.histogram(C.text_line(s, d))


@query("w1_cdf", f"WITH {C.TEXTMAP_SQL}, {_CDF} SELECT image_id, v, cnt, CAST(cum AS BIGINT) AS cum FROM c")
def w1(s, d):
    return R.cdf(packed.histogram(C.text_line(s, d)))


_EQ = "e AS (SELECT image_id, v, CAST(CASE WHEN n > l THEN round_even((cum - l) * 255.0::DOUBLE / (n - l), 0) ELSE v END AS INTEGER) AS eq FROM (SELECT *, sum(cnt) OVER (PARTITION BY image_id) AS n, min(cum) OVER (PARTITION BY image_id) AS l FROM c))"


@query("w2_equalization_levels", f"WITH {C.TEXTMAP_SQL}, {_CDF}, {_EQ} SELECT image_id, v, eq FROM e")
def w2(s, d):
    return R.equalized_levels(packed.histogram(C.text_line(s, d)))


@query("j1_lut_join", f"WITH {C.TEXTMAP_SQL}, {_CDF}, {_EQ} SELECT image_id, count(*) AS n, CAST(sum(eq * (x + 1)) AS BIGINT) AS checksum FROM textmap JOIN e USING (image_id, v) GROUP BY 1")
def j1(s, d):
    return R.equalize(C.textmap(s, d)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("eq") * (F.col("x") + 1)).cast("long").alias("checksum"))


_OTSU = """o AS (SELECT image_id, v, n, sum(cnt) OVER (PARTITION BY image_id) AS tn, m, sum(cnt * v) OVER (PARTITION BY image_id) AS tm FROM (SELECT *, sum(cnt) OVER w AS n, sum(cnt * v) OVER w AS m FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v))),
k AS (SELECT image_id, v, CASE WHEN n < tn THEN CAST(tm * n - tn * m AS DOUBLE) * CAST(tm * n - tn * m AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(tn - n AS DOUBLE)) ELSE -1 END AS s FROM o),
t AS (SELECT image_id, CASE WHEN s >= 0 THEN v ELSE 0 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, v) AS r FROM k) WHERE r = 1)"""


@query("w3_otsu", f"WITH {C.TEXTMAP_SQL}, {_HIST}, {_OTSU} SELECT image_id, threshold FROM t")
def w3(s, d):
    return R.otsu_of(packed.histogram(C.text_line(s, d)))


@query("w3_otsu_mask", f"WITH {C.TEXTMAP_SQL}, {_HIST}, {_OTSU} SELECT image_id, threshold, count(*) FILTER (WHERE v > threshold) AS fg_pixels FROM textmap JOIN t USING (image_id) GROUP BY 1, 2")
def w3_mask(s, d):
    cells = C.textmap(s, d)
    return cells.join(R.otsu(cells), "image_id").groupBy("image_id", "threshold").agg(F.count_if(F.col("v") > F.col("threshold")).alias("fg_pixels"))



_TAPS = "taps AS (SELECT * FROM (VALUES (-1), (0), (1)) t(o))"
_AT = "CASE WHEN {c} + {o} < 0 THEN -({c} + {o}) WHEN {c} + {o} > {n} THEN 2 * {n} - ({c} + {o}) ELSE {c} + {o} END"


def _pass(src: str, axis: str, n: int, weights: str, out: str) -> str:
    same = "y" if axis == "x" else "x"
    at = _AT.format(c=f"a.{axis}", o="o", n=n)
    return f"{out} AS (SELECT a.image_id, a.y, a.x, sum(b.v * ({weights})) AS v FROM heat a CROSS JOIN taps JOIN {src} b ON b.image_id = a.image_id AND b.{same} = a.{same} AND b.{axis} = {at} GROUP BY 1, 2, 3)"


_G = kernels.gaussian(3, 1.0)
_GW = f"CASE o WHEN 0 THEN {_G[1]!r}::DOUBLE ELSE {_G[0]!r}::DOUBLE END"


@query("w4_gaussian_blur", f"WITH {C.HEAT_SQL}, {_TAPS}, {_pass('heat', 'x', 23, _GW, 'p')}, {_pass('p', 'y', 30, _GW, 'q')} SELECT image_id, y, x, CAST(round_even(v, 0) AS INTEGER) AS v FROM q")
def w4(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), lambda a: kernels.blur(a, 3, 1.0))


@query("w5_median_filter", f"WITH {C.HEAT_SQL}, {_TAPS}, m AS (SELECT a.image_id, a.y, a.x, list_sort(list(b.v)) AS l FROM heat a CROSS JOIN taps t CROSS JOIN taps u JOIN heat b ON b.image_id = a.image_id AND b.y = {_AT.format(c='a.y', o='t.o', n=30)} AND b.x = {_AT.format(c='a.x', o='u.o', n=23)} GROUP BY 1, 2, 3) SELECT image_id, y, x, l[5] AS v FROM m")
def w5(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), lambda a: kernels.median(a, 3))


_SMOOTH, _STEP = "CASE o WHEN 0 THEN 2 ELSE 1 END", "o"
_SOBEL = f"{C.HEAT_SQL}, {_TAPS}, {_pass('heat', 'y', 30, _SMOOTH, 'sy')}, {_pass('sy', 'x', 23, _STEP, 'gx')}, {_pass('heat', 'x', 23, _SMOOTH, 'sx')}, {_pass('sx', 'y', 30, _STEP, 'gy')}"


def _peak(value: str) -> str:
    return f"SELECT image_id, y, x, CASE WHEN m > 0 THEN CAST(floor(g * (255.0::DOUBLE / m)) AS INTEGER) ELSE 0 END AS v FROM (SELECT *, max(g) OVER (PARTITION BY image_id) AS m FROM ({value}))"


@query("w7_sobel", f"WITH {_SOBEL} " + _peak("SELECT gx.image_id, gx.y, gx.x, sqrt(CAST(gx.v * gx.v + gy.v * gy.v AS DOUBLE)) AS g FROM gx JOIN gy USING (image_id, y, x)"))
def w7(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), kernels.sobel)


@query("w8_sobel_x", f"WITH {_SOBEL} " + _peak("SELECT image_id, y, x, abs(CAST(v AS DOUBLE)) AS g FROM gx"))
def w8(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), kernels.sobel_x)


@query("w6_clahe")
def w6(s, d):
    return packed.filtered(C.scene(s, d), kernels.clahe)


def _clahe(src: str, out: str, th: int, tw: int, limit: int) -> str:
    """Tiles of th x tw cells over 31 x 24, mirrored at the lower border, their histograms cut at `limit`."""
    ny, nx, size = -(-31 // th), 24 // tw, th * tw
    return f"""ti AS (SELECT a.image_id, ty, tx, b.v FROM (SELECT DISTINCT image_id FROM {src}) a CROSS JOIN range(0, {ny}) q(ty) CROSS JOIN range(0, {nx}) r(tx) CROSS JOIN range(0, {th}) i(dy) CROSS JOIN range(0, {tw}) j(dx)
  JOIN {src} b ON b.image_id = a.image_id AND b.y = CASE WHEN ty * {th} + dy > 30 THEN 60 - (ty * {th} + dy) ELSE ty * {th} + dy END AND b.x = tx * {tw} + dx),
tn AS (SELECT image_id, ty, tx, v, least(count(*), {limit}) AS n, greatest(count(*) - {limit}, 0) AS over FROM ti GROUP BY 1, 2, 3, 4),
te AS (SELECT image_id, ty, tx, sum(over) AS over FROM tn GROUP BY 1, 2, 3),
tl AS (SELECT te.image_id, te.ty, te.tx, lv AS v, coalesce(n, 0) + te.over // 256 + CASE WHEN lv < te.over % 256 THEN 1 ELSE 0 END AS n FROM te CROSS JOIN range(0, 256) g(lv) LEFT JOIN tn ON tn.image_id = te.image_id AND tn.ty = te.ty AND tn.tx = te.tx AND tn.v = lv),
tu AS (SELECT image_id, ty, tx, v, round_even(CAST(sum(n) OVER (PARTITION BY image_id, ty, tx ORDER BY v) AS DOUBLE) * 255 / {size}, 0) AS e FROM tl),
tw AS (SELECT *, least(greatest(y / {th}.0::DOUBLE - 0.5, 0), {ny - 1}) AS py, least(greatest(x / {tw}.0::DOUBLE - 0.5, 0), {nx - 1}) AS px FROM {src}),
tp AS (SELECT image_id, y, x, v, CAST(floor(py) AS INTEGER) AS ty, CAST(floor(px) AS INTEGER) AS tx, py - floor(py) AS fy, px - floor(px) AS fx FROM tw),
{out} AS (SELECT w.image_id, w.y, w.x, CAST(round_even((a.e * (1 - fx) + b.e * fx) * (1 - fy) + (c.e * (1 - fx) + d.e * fx) * fy, 0) AS INTEGER) AS v FROM tp w
JOIN tu a ON a.image_id = w.image_id AND a.v = w.v AND a.ty = w.ty AND a.tx = w.tx JOIN tu b ON b.image_id = w.image_id AND b.v = w.v AND b.ty = w.ty AND b.tx = least(w.tx + 1, {nx - 1})
JOIN tu c ON c.image_id = w.image_id AND c.v = w.v AND c.ty = least(w.ty + 1, {ny - 1}) AND c.tx = w.tx JOIN tu d ON d.image_id = w.image_id AND d.v = w.v AND d.ty = least(w.ty + 1, {ny - 1}) AND d.tx = least(w.tx + 1, {nx - 1}))"""


@query("w6_clahe_cells", f"WITH {C.HEAT_SQL}, {_clahe('heat', 'en', 16, 12, 6)} SELECT * FROM en")
def w6_cells(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), lambda a: kernels.clahe(a, (2, 2), 8.0))


_ENHANCED = f"{_TAPS}, {_pass('heat', 'x', 23, _GW, 'bx')}, {_pass('bx', 'y', 30, _GW, 'bxy')}, bl AS (SELECT image_id, y, x, CAST(round_even(v, 0) AS INTEGER) AS v FROM bxy), {_clahe('bl', 'en', 4, 3, 1)}"


@query("g2_preprocess_cells", f"WITH {C.HEAT_SQL}, {_ENHANCED}, {_HIST.replace('textmap', 'en')}, {_OTSU} SELECT en.image_id, y, x, CASE WHEN en.v <= threshold THEN 255 ELSE 0 END AS v FROM en JOIN t USING (image_id)")
def g2_cells(s, d):
    return packed.filtered_cells(C.heat_packed(s, d), packed.preprocessed)


_MASK = "b AS (SELECT image_id, y, x, CASE WHEN v > 0 THEN 255 ELSE 0 END AS v FROM heat)"


def _slide(src: str, out: str, axis: str, r: int, f: str) -> str:
    other = "y" if axis == "x" else "x"
    over = f"OVER (PARTITION BY image_id, {other} ORDER BY {axis} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    value = f"max(v) {over}" if f == "max" else f"CASE WHEN count(*) {over} = {2 * r + 1} THEN min(v) {over} ELSE 0 END"
    return f"{out} AS (SELECT image_id, y, x, {value} AS v FROM {src})"


_DILATE = f"{_slide('b', 'd1', 'x', 2, 'max')}, {_slide('d1', 'd2', 'y', 1, 'max')}"
_ERODE = f"{_slide('b', 'e1', 'x', 1, 'min')}, {_slide('e1', 'e2', 'y', 1, 'min')}"
_CLOSE = f"{_DILATE}, {_slide('d2', 'c1', 'x', 2, 'min')}, {_slide('c1', 'c2', 'y', 1, 'min')}"
_OPEN = f"{_ERODE}, {_slide('e2', 'o1', 'x', 1, 'max')}, {_slide('o1', 'o2', 'y', 1, 'max')}"


@query("w9_dilate", f"WITH {C.HEAT_SQL}, {_MASK}, {_DILATE} SELECT * FROM d2")
def w9(s, d):
    return R.dilate(C.heat(s, d), 3, 5).select("image_id", "y", "x", "v")


@query("w10_erode", f"WITH {C.HEAT_SQL}, {_MASK}, {_ERODE} SELECT * FROM e2")
def w10(s, d):
    return R.erode(C.heat(s, d), 3, 3).select("image_id", "y", "x", "v")


@query("w11_closing", f"WITH {C.HEAT_SQL}, {_MASK}, {_CLOSE} SELECT * FROM c2")
def w11(s, d):
    return R.erode(R.dilate(C.heat(s, d), 3, 5), 3, 5).select("image_id", "y", "x", "v")


@query("w11_opening", f"WITH {C.HEAT_SQL}, {_MASK}, {_OPEN} SELECT * FROM o2")
def w11_open(s, d):
    return R.dilate(R.erode(C.heat(s, d), 3, 3), 3, 3).select("image_id", "y", "x", "v")


@query("w12_adaptive_dark_threshold", f"WITH {C.HEAT_SQL} SELECT a.image_id, a.y, a.x, CASE WHEN a.v < CAST(sum(b.v) AS DOUBLE) / count(*) - 5 THEN 255 ELSE 0 END AS v FROM heat a JOIN heat b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.image_id, a.y, a.x, a.v")
def w12(s, d):
    return R.box_dark(C.heat(s, d), 5, 5.0)


_RUNS = "r AS (SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM heat WHERE v > 0) GROUP BY image_id, y, g)"


@query("w16_row_runs", f"WITH {C.HEAT_SQL}, {_RUNS} SELECT * FROM r")
def w16(s, d):
    return R.row_runs(C.heat_lit(s, d))


def _cc(source: str, lit: str, width: int) -> str:
    """Components (table n) of the lit cells of a LONG table, numbered by their first cell in raster order."""
    return f"""cells AS (SELECT image_id, y, x FROM {source} WHERE {lit}),
reach(image_id, y, x, ry, rx) AS (SELECT image_id, y, x, y, x FROM cells UNION SELECT c.image_id, c.y, c.x, r.ry, r.rx FROM reach r JOIN cells c ON c.image_id = r.image_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1),
l AS (SELECT image_id, y, x, min(ry * {width} + rx) AS root FROM reach GROUP BY 1, 2, 3),
n AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM l)"""


_CC = _cc("heat", "v > 0", 24)


@query("g1_connected_components", f"WITH RECURSIVE {C.HEAT_SQL}, {_CC} SELECT image_id, CAST(label AS INTEGER) AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY 1, 2")
def g1(s, d):
    return packed.components(C.heat_packed(s, d))


@query("f1_component_geometry", f"WITH RECURSIVE {C.HEAT_SQL}, {_CC}, k AS (SELECT image_id, label, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area FROM n GROUP BY 1, 2) SELECT image_id, CAST(label AS INTEGER) AS label, width::DOUBLE / height AS aspect_ratio, area::DOUBLE / (width * height) AS fill_ratio FROM k WHERE width >= 2 AND width::DOUBLE / height BETWEEN 0.5 AND 6.5 AND area::DOUBLE / (width * height) >= 0.3")
def f1(s, d):
    c = packed.components(C.heat_packed(s, d))
    aspect, fill = F.col("width") / F.greatest(F.lit(1), F.col("height")), F.col("area") / F.greatest(F.lit(1), F.col("width") * F.col("height"))
    return c.where((F.col("width") >= 2) & aspect.between(0.5, 6.5) & (fill >= 0.3)).select("image_id", "label", aspect.alias("aspect_ratio"), fill.alias("fill_ratio"))


@query("a3_hough_votes", f"WITH {C.HEAT_SQL}, b AS (SELECT image_id, theta, CAST(round_even(round(x * cos(radians(theta)) + y * sin(radians(theta)) + sqrt(31.0 * 31 + 24.0 * 24), 9), 0) AS INTEGER) AS bin, count(*) AS votes FROM heat CROSS JOIN (VALUES (85.0::DOUBLE), (87.5), (90.0), (92.5), (95.0)) t(theta) WHERE v > 0 GROUP BY 1, 2, 3) SELECT image_id, theta, bin, round(bin - sqrt(31.0 * 31 + 24.0 * 24), 6) AS rho, votes FROM b")
def a3(s, d):
    return R.hough_votes(C.heat_lit(s, d), [85.0, 87.5, 90.0, 92.5, 95.0], 31, 24).withColumn("rho", F.round("rho", 6))


def _peaks(thetas: str, most: int) -> str:
    """Peaks of the votes of the lit heat cells (table p): the greatest first, each clears 6 bins and 2 angles around it."""
    return f"""a AS (SELECT k, {thetas} AS theta FROM range(0, 1000) r(k) WHERE {thetas} < 180),
v AS (SELECT image_id, k, theta, CAST(round_even(round(x * cos(radians(theta)) + y * sin(radians(theta)) + sqrt(31.0 * 31 + 24.0 * 24), 9), 0) AS INTEGER) AS bin, count(*) AS votes FROM heat CROSS JOIN a WHERE v > 0 GROUP BY ALL HAVING count(*) >= 8),
left_over AS (SELECT 1 AS step, * FROM v UNION ALL SELECT step + 1, image_id, k, theta, bin, votes FROM (SELECT *, first_value(bin) OVER w AS pb, first_value(k) OVER w AS pk FROM left_over WINDOW w AS (PARTITION BY image_id ORDER BY votes DESC, bin, k)) WHERE step < {most} AND (abs(bin - pb) > 6 OR abs(k - pk) > 2)),
p AS (SELECT image_id, theta, bin, votes FROM (SELECT *, row_number() OVER (PARTITION BY image_id, step ORDER BY votes DESC, bin, k) AS r FROM left_over) WHERE r = 1)"""


_SKEW = _peaks("75 + k * 0.5::DOUBLE", 5).replace("< 180", "<= 105")


@query("g5_skew_angle", f"WITH RECURSIVE {C.HEAT_SQL}, {_SKEW} SELECT u.image_id, round(coalesce(sum((theta - 90) * votes) / sum(votes), 0), 9) AS angle FROM (SELECT DISTINCT image_id FROM heat) u LEFT JOIN p USING (image_id) GROUP BY 1")
def g5(s, d):
    return packed.skew(C.heat_packed(s, d)).withColumn("angle", F.round("angle", 9))


@query("a4_zoning", f"WITH {C.GLYPH8_SQL} SELECT image_id, CAST(y // 2 * 4 + x // 2 AS INTEGER) AS zone, avg(CASE WHEN v > 127 THEN 1 ELSE 0 END) AS share FROM glyph8 GROUP BY 1, 2")
def a4(s, d):
    return R.zones(C.glyph8(s, d), 8, 4)


@query("a7_column_projection", f"WITH {C.HEAT_SQL} SELECT image_id, x, count(*) FILTER (WHERE v > 0) AS fg FROM heat GROUP BY 1, 2")
def a7(s, d):
    return C.heat(s, d).groupBy("image_id", "x").agg(F.count_if(F.col("v") > 0).alias("fg"))


_HOG = """gr AS (SELECT image_id, y // 4 * 2 + x // 4 AS cell, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / 255.0::DOUBLE AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / 255.0::DOUBLE AS gy
  FROM glyph8 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
an AS (SELECT image_id, cell, sqrt(gx * gx + gy * gy) AS m, fmod(degrees(atan2(gy, gx)) + 180, 180) / 20 AS turn FROM gr),
pt AS (SELECT image_id, cell, CAST(floor(turn) AS INTEGER) % 9 AS bin, m * (1 - (turn - floor(turn))) AS h FROM an UNION ALL SELECT image_id, cell, (CAST(floor(turn) AS INTEGER) + 1) % 9, m * (turn - floor(turn)) FROM an),
hs AS (SELECT image_id, cell * 9 + bin AS i, sum(h) AS h FROM pt GROUP BY 1, 2),
hg AS (SELECT u.image_id, g.i, coalesce(h, 0) / sqrt(sum(coalesce(h * h, 0)) OVER (PARTITION BY u.image_id) + 1e-12) AS value FROM (SELECT DISTINCT image_id FROM glyph8) u CROSS JOIN range(0, 36) g(i) LEFT JOIN hs ON hs.image_id = u.image_id AND hs.i = g.i),
zn AS (SELECT image_id, 36 + y // 2 * 4 + x // 2 AS i, avg(CASE WHEN v > 127 THEN 1 ELSE 0 END) AS value FROM glyph8 GROUP BY 1, 2)"""


@query("g15_glyph_features", f"WITH {C.GLYPH8_SQL}, {_HOG} SELECT image_id, CAST(i AS INTEGER) AS i, round(value, 7) AS value FROM (SELECT * FROM hg UNION ALL SELECT * FROM zn)")
def g15(s, d):
    return packed.feature_cells(C.packed(C.glyph8(s, d).drop("label"))).withColumn("value", F.round("value", 7))


_VEC = "vec AS (SELECT image_id, label, list(v ORDER BY y, x) AS vec FROM glyph8 GROUP BY 1, 2)"
_PAIRS = "d AS (SELECT q.image_id, t.image_id AS train_id, t.label, list_sum(list_transform(range(1, 65), lambda i: (q.vec[i] - t.vec[i]) * (q.vec[i] - t.vec[i]))) AS d FROM vec q, vec t WHERE q.image_id % 20 = 0 AND t.image_id <> q.image_id)"
_KNN = "knn AS (SELECT image_id, label, count(*) / 3::DOUBLE AS p FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, train_id) AS r FROM d) WHERE r <= 3 GROUP BY 1, 2)"
_TPL = "z AS (SELECT image_id, label, -(min(d)::DOUBLE / 4161600.0::DOUBLE) / 0.035::DOUBLE AS z FROM d GROUP BY 1, 2), e AS (SELECT image_id, label, exp(z - max(z) OVER (PARTITION BY image_id)) AS e FROM z), tpl AS (SELECT image_id, label, e / sum(e) OVER (PARTITION BY image_id) AS p FROM e)"


def _queries_and_all(s, d):
    """The search's fixed query set, ids divisible by 20, and all rows; no row is its own neighbour."""
    v = classify.vectors(C.glyph8(s, d))
    return v.where("image_id % 20 = 0"), v


@query("c1_knn", f"WITH {C.GLYPH8_SQL}, {_VEC}, {_PAIRS}, {_KNN} SELECT image_id, label, round(p, 9) AS p FROM knn")
def c1(s, d):
    return classify.knn(*_queries_and_all(s, d)).withColumn("p", F.round("p", 9))


@query("c4_pixel_template", f"WITH {C.GLYPH8_SQL}, {_VEC}, {_PAIRS}, {_TPL} SELECT image_id, label, round(p, 6) AS p FROM tpl")
def c4(s, d):
    return classify.templates(*_queries_and_all(s, d)).withColumn("p", F.round("p", 6))


_BLEND = "bl AS (SELECT image_id, label, sum(p) AS p FROM (SELECT image_id, label, p * (0.2 / 0.9) AS p FROM tpl UNION ALL SELECT image_id, label, p * (0.7 / 0.9) FROM knn) GROUP BY 1, 2)"


@query("c7_blend_top_class", f"WITH {C.GLYPH8_SQL}, {_VEC}, {_PAIRS}, {_KNN}, {_TPL}, {_BLEND} SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(p, 9) DESC, label) AS r FROM bl) WHERE r = 1")
def c7(s, d):
    both = classify.blended_search(*_queries_and_all(s, d))
    return R.top_class(both.withColumn("p", F.round("p", 9))).select("image_id", "label")


@query("c2_mlp")
def c2(s, d):
    every = classify.vectors(C.glyph8(s, d))
    return R.top_class(classify.mlp(every, every, hidden=(32,), epochs=20, rate=0.05))


@query("a10_class_prototypes", f"WITH {C.GLYPH8_SQL} SELECT label, y, x, avg(v) AS mean FROM glyph8 GROUP BY 1, 2, 3")
def a10(s, d):
    return C.glyph8(s, d).groupBy("label", "y", "x").agg(F.avg("v").alias("mean"))


@query("j3_labels_evaluation", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE quality = 1) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def j3(s, d):
    docs, labels = C.table(s, d, "documents").select("doc_id", "lang"), C.table(s, d, "labels").withColumn("seen", F.lit(True))
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("seen").isNull()).alias("missing"), F.count_if(F.col("quality") == 1).alias("good"))


_X2 = "list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i = 3 THEN translate(c[i], '012568', 'OIZSGB') ELSE translate(c[i], 'OQDILZSGB', '000112568') END)"


@query("x2_slot_correction", f"SELECT c_custkey, array_to_string({_X2}, '') AS corrected, CASE WHEN length(c) <= 3 THEN c ELSE c[1:3] || '-' || c[4:] END AS formatted, rpad(CASE WHEN length(c) >= 3 THEN 'DDL' ELSE 'DDL'[1:length(c)] END, CAST(length(c) AS INTEGER), 'D') AS slots FROM (SELECT c_custkey, regexp_replace(upper(c_name), '[^0-9A-Z]', '', 'g') AS c FROM customer)")
def x2(s, d):
    name = F.col("c_name")
    return C.table(s, d, "customer").select("c_custkey", T.corrected(name).alias("corrected"), T.format_plate(name).alias("formatted"), T.plate_slots(F.length(T.compact(name))).alias("slots"))


@query("x7_label_normalize", "SELECT p_partkey, regexp_replace(upper(p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS label, regexp_extract(upper(p_brand), '[0-9A-Z]') AS first FROM part")
def x7(s, d):
    return C.table(s, d, "part").select("p_partkey", T.normalize_label(F.col("p_brand")).alias("label"), T.clean_label(F.col("p_brand")).alias("first"))


@query("t1_top_candidates", f"WITH RECURSIVE {C.HEAT_SQL}, {_CC}, k AS (SELECT image_id, label, count(*) AS area FROM n GROUP BY 1, 2) SELECT image_id, CAST(label AS INTEGER) AS label, area, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS r FROM k) WHERE r <= 5")
def t1(s, d):
    from pyspark.sql import Window

    c = packed.components(C.heat_packed(s, d))
    return c.select("image_id", "label", "area", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "label")).alias("r")).where("r <= 5")


@query("g3_detect_plate")
def g3(s, d):
    return packed.detect(C.scene(s, d))


_EDGES = _SOBEL + ", ed AS (" + _peak("SELECT image_id, y, x, abs(CAST(v AS DOUBLE)) AS g FROM gx") + "), b AS (SELECT image_id, y, x, CASE WHEN v > floor(0.2::DOUBLE * max(v) OVER (PARTITION BY image_id)) THEN 255 ELSE 0 END AS v FROM ed)"
_FOUND = """k AS (SELECT image_id, CAST(label AS INTEGER) AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY 1, 2),
cd AS (SELECT k.*, width::DOUBLE / height AS aspect_ratio, area::DOUBLE / (width * height) AS fill_ratio, (SELECT count(*) FROM b WHERE b.image_id = k.image_id AND b.v > 0 AND b.x >= k.x AND b.x < k.x + k.width AND b.y >= k.y AND b.y < k.y + k.height)::DOUBLE / (width * height) AS gradient_density FROM k),
sc AS (SELECT *, exp(-power(aspect_ratio - 3.5, 2) / 4.5) * least(1, (fill_ratio - 0.3) / 0.7) * least(1, (gradient_density - 0.1) / 0.4) AS score FROM cd
  WHERE height >= 2 AND width >= 3 AND aspect_ratio BETWEEN 0.5 AND 6.5 AND width * height / 744.0::DOUBLE BETWEEN 0.005 AND 0.9 AND fill_ratio >= 0.3 AND gradient_density >= 0.1)"""


@query("g3_detect_cells", f"WITH RECURSIVE {_EDGES}, {_CLOSE}, {_cc('c2', 'v > 0', 24)}, {_FOUND} SELECT image_id, label, x, y, width, height, area, aspect_ratio, fill_ratio, round(gradient_density, 9) AS gradient_density, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 12) DESC, label) AS r FROM sc) WHERE r <= 5")
def g3_cells(s, d):
    cfg = Detection(closing=(3, 5), aspect=(0.5, 6.5), area=(0.005, 0.9), min_height=2, min_width=3)
    found = packed.detect_in(C.heat_packed(s, d), cfg)
    return found.drop("cx", "cy").withColumn("gradient_density", F.round("gradient_density", 9)).withColumn("score", F.round("score", 9))


@query("g7_segment_characters")
def g7(s, d):
    return packed.segment(packed.normalize(C.scene(s, d)))


@query("g6_normalize_plate")
def g6(s, d):
    return packed.normalize(C.scene(s, d))


@query("q1_analyze")
def q1(s, d):
    return packed.read_plates(C.scene(s, d))


@query("q2_recognize")
def q2(s, d):
    return packed.first_candidate(C.scene(s, d))


@query("b1_preprocess_large")
def b1(s, d):
    """Step 1 on 768 x 1024 images."""
    return packed.filtered(C.large_scene(s, d), packed.preprocessed)


@query("b2_detect_large")
def b2(s, d):
    """Steps 1 and 2 on 768 x 1024 images."""
    return packed.detect(C.large_scene(s, d))
