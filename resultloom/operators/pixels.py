"""Pixel statistics over a long table (image_id, y, x, r, g, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..plans import skew

TILE = 64


def grey(r="r", g="g", b="b"):
    """Luma in whole numbers."""
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    return F.floor((r.cast("long") * 19595 + g.cast("long") * 38470 + b.cast("long") * 7471 + 32768) / F.lit(65536)).cast("long")


def edge_density(pixels: DataFrame) -> DataFrame:
    """Share of pixels whose grey differs from the right plus the lower neighbour by more than the limit.

    The picture is cut into tiles of fixed size; only border pixels are sent to two tiles. One shuffle by tile serves
    both neighbour directions, and no task ever holds more than a tile at a time, however large the picture.
    """
    df = pixels.select("image_id", "y", "x", grey().alias("v"))
    ty, tx = F.floor(F.col("y") / TILE).cast("long"), F.floor(F.col("x") / TILE).cast("long")
    above, left = F.col("y") % TILE == 0, F.col("x") % TILE == 0
    copies = F.array_compact(F.array(
        F.struct(ty.alias("ty"), tx.alias("tx"), F.lit(True).alias("own")),
        F.when(above & (F.col("y") > 0), F.struct((ty - 1).alias("ty"), tx.alias("tx"), F.lit(False).alias("own"))),
        F.when(left & (F.col("x") > 0), F.struct(ty.alias("ty"), (tx - 1).alias("tx"), F.lit(False).alias("own")))))
    df = df.select("image_id", "y", "x", "v", F.explode(copies).alias("t")).select("image_id", "y", "x", "v", "t.*")
    tile = ["image_id", "ty", "tx"]
    df = df.repartition(*tile)
    right = F.lead("v").over(Window.partitionBy(*tile, "y").orderBy("x"))
    below = F.lead("v").over(Window.partitionBy(*tile, "x").orderBy("y"))
    df = df.withColumn("vr", right).withColumn("vb", below).filter("own AND vr IS NOT NULL AND vb IS NOT NULL")
    edge = (F.abs(F.col("vr") - F.col("v")) + F.abs(F.col("vb") - F.col("v"))) > fixed.EDGE_STEP
    return df.groupBy("image_id").agg(F.avg(edge.cast("int")).alias("edge_density"))


def with_frame(pixels: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Every pixel with the size of its picture and the colour of its corner."""
    corner = F.max(F.when((F.col("x") == 0) & (F.col("y") == 0), F.struct("r", "g", "b")))
    return skew.attach(pixels, ["image_id"], hot_rows, few_groups=True, w=F.max("x") + 1, h=F.max("y") + 1, corner=corner)


def _cut(c, share):
    return F.floor(F.col(c) * F.lit(share))


def pixel_stats(framed: DataFrame, blue_min: int = 30, cyan_min: int = 8, dead_band: float = 3.0, pad_share: float = 0.012,
                min_pad: int = 4) -> DataFrame:
    """Z direction, red pixels and content box of every picture in one aggregation that Spark combines before the shuffle."""
    r, g, b, x, y = (F.col(c) for c in ("r", "g", "b", "x", "y"))
    low_right = (y >= _cut("h", 0.55)) & (x >= _cut("w", 0.55))
    blue = low_right & (b > 110) & (r < 60) & (g < 60)
    cyan = low_right & (r < 90) & (g > 150) & (b > 150)
    legend = (y < _cut("h", 0.62)) & (x < _cut("w", 0.27))
    triad = (y >= _cut("h", 0.55)) & (x >= _cut("w", 0.80))
    red = (r > 200) & (g < 50) & (b < 50) & ~legend & ~triad
    diff = grey(*[F.abs(F.col(c) - F.col(f"corner.{c}")) for c in "rgb"]) > 14
    df = framed.groupBy("image_id").agg(
        F.count_if(blue).alias("nb"), F.count_if(cyan).alias("nc"), F.sum(F.when(blue, y)).alias("sb"), F.sum(F.when(cyan, y)).alias("sc"),
        F.count_if(red).alias("red_px"), F.min(F.when(diff, x)).alias("l0"), F.min(F.when(diff, y)).alias("t0"), F.max(F.when(diff, x)).alias("r0"),
        F.max(F.when(diff, y)).alias("b0"), F.first("w").alias("w"), F.first("h").alias("h"))
    my, mc = F.col("sb") / F.col("nb"), F.col("sc") / F.col("nc")
    z = F.when((F.col("nb") >= blue_min) & (F.col("nc") >= cyan_min), F.when(my < mc - dead_band, F.lit("up")).when(my > mc + dead_band, F.lit("down")))
    pad = F.greatest(F.lit(min_pad), F.floor(F.greatest("w", "h") * pad_share))
    df = df.withColumn("z_dir", z).withColumns({
        "box_l": F.greatest(F.lit(0), F.col("l0") - pad), "box_t": F.greatest(F.lit(0), F.col("t0") - pad),
        "box_r": F.least(F.col("w"), F.col("r0") + 1 + pad), "box_b": F.least(F.col("h"), F.col("b0") + 1 + pad)})
    area = (F.col("box_r") - F.col("box_l")) * (F.col("box_b") - F.col("box_t"))
    some = F.col("l0").isNotNull()
    df = df.withColumn("applied", some & (area < F.col("w") * F.col("h") * 0.97))
    keep = {"box_l": F.lit(0), "box_t": F.lit(0), "box_r": F.col("w"), "box_b": F.col("h")}
    df = df.withColumns({c: F.when(F.col("applied"), F.col(c)).otherwise(v).cast("long") for c, v in keep.items()})
    return df.select("image_id", "z_dir", "red_px", "box_l", "box_t", "box_r", "box_b", "applied")


def z_direction(pixels: DataFrame, **limits) -> DataFrame:
    return pixel_stats(with_frame(pixels), **limits).select("image_id", "z_dir")


def red_count(pixels: DataFrame) -> DataFrame:
    return pixel_stats(with_frame(pixels)).select("image_id", "red_px")


def content_bbox(pixels: DataFrame, pad_share: float = 0.012, min_pad: int = 4) -> DataFrame:
    return pixel_stats(with_frame(pixels), pad_share=pad_share, min_pad=min_pad).select("image_id", "box_l", "box_t", "box_r", "box_b", "applied")


def analysis_scale(pictures: DataFrame) -> DataFrame:
    """Scale for analysis and for placing: long sides above the limit are brought down to it."""
    long_side = F.greatest("width", "height")
    return pictures.select("job_id", "id", F.least(F.lit(1.0), F.lit(fixed.ANALYSIS_SIDE) / long_side).alias("k_analysis"),
                           F.least(F.lit(1.0), F.lit(fixed.PLACE_SIDE) / long_side).alias("k_place"))
