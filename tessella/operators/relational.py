"""Operators over LONG rasters as DataFrame expressions, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grayscale(df: DataFrame) -> DataFrame:
    """Adds v: luma rounded half-even."""
    return df.withColumn("v", F.least(F.lit(255), F.rint(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))).cast("int"))


def fixed_threshold(v: Column, t: int = 128, invert: bool = False) -> Column:
    if not 0 <= t <= 255:
        raise ValueError("the threshold lies between 0 and 255")
    return F.when((v <= t) if invert else (v > t), 255).otherwise(0)


def histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id", "v").agg(F.count("*").alias("cnt"))


def cdf(hist: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cum", F.sum("cnt").over(so_far))


def equalized_levels(hist: DataFrame) -> DataFrame:
    """(image_id, v, eq) of a histogram: the level each level becomes; a constant raster stays."""
    whole = Window.partitionBy("image_id")
    c = cdf(hist).withColumn("n", F.sum("cnt").over(whole)).withColumn("least", F.min("cum").over(whole))
    return c.select("image_id", "v", F.when(F.col("n") > F.col("least"), F.rint((F.col("cum") - F.col("least")) * 255.0 / (F.col("n") - F.col("least")))).otherwise(F.col("v")).cast("int").alias("eq"))


def equalize(df: DataFrame) -> DataFrame:
    return df.join(equalized_levels(histogram(df)), ["image_id", "v"]).select("image_id", "y", "x", "v", "eq")


def otsu(df: DataFrame) -> DataFrame:
    """(image_id, threshold): exact in integers; 0 for a constant raster."""
    return otsu_of(histogram(df))


def otsu_of(hist: DataFrame) -> DataFrame:
    whole, so_far = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.select("image_id", "v", F.sum("cnt").over(so_far).alias("n"), F.sum(F.col("cnt") * F.col("v")).over(so_far).alias("m"), F.sum("cnt").over(whole).alias("tn"), F.sum(F.col("cnt") * F.col("v")).over(whole).alias("tm"))
    gap = (F.col("tm") * F.col("n") - F.col("tn") * F.col("m")).cast("double")
    s = F.when(F.col("n") < F.col("tn"), gap * gap / (F.col("n").cast("double") * (F.col("tn") - F.col("n")))).otherwise(-1.0)
    best = h.select("image_id", F.struct(s.alias("s"), (-F.col("v")).alias("v")).alias("k")).groupBy("image_id").agg(F.max("k").alias("k"))
    return best.select("image_id", F.when(F.col("k.s") >= 0, -F.col("k.v")).otherwise(0).alias("threshold"))


def scaled_by_peak(df: DataFrame) -> DataFrame:
    peak = F.max("v").over(Window.partitionBy("image_id"))
    return df.withColumn("scaled", F.when(peak > 0, F.floor(F.col("v") * (F.lit(255.0) / peak))).otherwise(0).cast("int"))


def _frame(axis: str, r: int):
    other = "x" if axis == "y" else "y"
    return Window.partitionBy("image_id", other).orderBy(axis).rowsBetween(-r, r)


def dilate(df: DataFrame, h: int, w: int) -> DataFrame:
    """Odd extents: a mirrored border adds no new cells to the window."""
    if h % 2 == 0 or w % 2 == 0:
        raise ValueError("even extents need the packed kernel")
    flat = df.withColumn("v", F.when(F.col("v") > 0, 255).otherwise(0))
    return flat.withColumn("v", F.max("v").over(_frame("x", w // 2))).withColumn("v", F.max("v").over(_frame("y", h // 2)))


def erode(df: DataFrame, h: int, w: int) -> DataFrame:
    """Outside is 0, so a cut window is 0."""
    out = df.withColumn("v", F.when(F.col("v") > 0, 255).otherwise(0))
    for axis, n in (("x", w), ("y", h)):
        full = F.count("*").over(_frame(axis, n // 2)) == n
        out = out.withColumn("v", F.when(full, F.min("v").over(_frame(axis, n // 2))).otherwise(0))
    return out


def box_dark(df: DataFrame, size: int, offset: float) -> DataFrame:
    if size <= 0 or size % 2 == 0:
        raise ValueError("the window must be odd and positive")
    r = size // 2
    row = df.withColumn("s", F.sum("v").over(_frame("x", r))).withColumn("c", F.count("*").over(_frame("x", r)))
    both = row.withColumn("s", F.sum("s").over(_frame("y", r))).withColumn("c", F.sum("c").over(_frame("y", r)))
    return both.select("image_id", "y", "x", F.when(F.col("v") < F.col("s") / F.col("c") - offset, 255).otherwise(0).alias("v"))


def row_runs(df: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1): half-open runs of non-zero cells."""
    fg = df.where("v > 0").withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x")))
    return fg.groupBy("image_id", "y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("g")


def component_stats(cells: DataFrame) -> DataFrame:
    return cells.where("label > 0").groupBy("image_id", "label").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def plate_score(aspect: Column, fill: Column, density: Column) -> Column:
    def unit(c):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    return F.exp(-F.pow(aspect - 3.5, 2) / 4.5) * unit((fill - 0.30) / 0.70) * unit((density - 0.10) / 0.40)


def hough_votes(df: DataFrame, thetas: list[float], h: int, w: int) -> DataFrame:
    """(image_id, theta, bin, rho, votes) of non-zero cells of h x w rasters; each cell votes once
    a theta. Bins are whole steps of rho from minus the diagonal."""
    reach = float(h * h + w * w) ** 0.5
    t = F.explode(F.array(*[F.lit(float(a)) for a in thetas]))
    v = df.where("v > 0").select("image_id", "x", "y", t.alias("theta"))
    at = F.rint(F.round(F.col("x") * F.cos(F.radians("theta")) + F.col("y") * F.sin(F.radians("theta")) + reach, 9)).cast("int")
    return v.groupBy("image_id", "theta", at.alias("bin")).agg(F.count("*").alias("votes")).withColumn("rho", F.col("bin") - reach)


def zones(df: DataFrame, size: int, grid: int, over: int = 127) -> DataFrame:
    """(image_id, zone, share) of cells above `over`, for rasters of size x size."""
    zone = F.expr(f"cast(y * {grid} div {size} as int) * {grid} + cast(x * {grid} div {size} as int)")
    return df.groupBy("image_id", zone.alias("zone")).agg(F.avg((F.col("v") > over).cast("int")).alias("share"))


def crop(df: DataFrame, x: int, y: int, w: int, h: int, margin: float, fill: int = 255) -> DataFrame:
    if w <= 0 or h <= 0 or margin < 0:
        raise ValueError("the box must have a size and the margin may not be negative")
    mx, my = round(w * margin), round(h * margin)
    grid = df.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(h + 2 * my - 1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(w + 2 * mx - 1))).alias("tx"))
    at = grid.withColumn("y", F.col("ty") + (y - my)).withColumn("x", F.col("tx") + (x - mx))
    return at.join(df, ["image_id", "y", "x"], "left").select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), F.coalesce("v", F.lit(fill)).alias("v"))


def softmax(df: DataFrame, logit: str) -> DataFrame:
    by = Window.partitionBy("image_id")
    e = df.withColumn("e", F.exp(F.col(logit) - F.max(logit).over(by)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(by)).drop("e")


def top_class(probabilities: DataFrame) -> DataFrame:
    """(image_id, label, p): the likeliest class, the smallest on a tie."""
    best = F.max(F.struct("p", (-F.col("label")).alias("n"))).alias("k")
    return probabilities.groupBy("image_id").agg(best).select("image_id", (-F.col("k.n")).alias("label"), F.col("k.p").alias("p"))
