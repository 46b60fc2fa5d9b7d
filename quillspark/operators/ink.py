"""Vector ink: strokes to profiles, colours, blocks and stroke statistics. Strokes are read from their source once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.workers import parts

# What makes a ruled guide line, the gap between blocks, the patterns of vector sources.
RULE_WIDTH, RULE_HEIGHT = 300.0, 1.0
BLOCK_GAP = 10.0
BLANK_POINTS = 20
SVG_PATH = r"(?s)<path\s+([^>]*?)/>"
SVG_NUMBER = r"-?\d+\.?\d*(?:[eE][-+]?\d+)?"
SVG_POINT = r"[ML]\s*[-\d.]+\s+([-\d.]+)"
# End of fixed values.

#: Bytes of a plan's input for each partition of strokes that are sorted by page: blocks take some twenty to sixty times as much memory there as lineitem takes in files.
BYTES_SORTED = 4 << 20


def is_rule(width: Column, height: Column) -> Column:
    """As wide as a page and flat: a guide line, whatever its colour."""
    return (width > RULE_WIDTH) & (height < RULE_HEIGHT)


def rgb(percent: Column) -> Column:
    """Three comma-separated percentages as 0 to 255; null if they aren't three numbers."""
    channel = lambda p: F.rint(F.trim(p).try_cast("double") * 255 / 100).cast("int")
    channels = F.transform(F.split(F.replace(percent, F.lit("%"), F.lit("")), ","), channel)
    one = lambda c: F.when((F.size(c) == 3) & ~F.exists(c, lambda p: p.isNull()), F.struct(c[0].alias("r"), c[1].alias("g"), c[2].alias("b")))
    return F.transform(F.array(channels), one)[0]  # a list of one, so the channels are read once for all that looks at them


def strokes(pages: DataFrame, page: str = "page", svg: str = "svg") -> DataFrame:
    """A row a stroked path: (page, ordinal, colour, stroke_w, x0, y0, x1, y1), the whole affine matrix applied; and its extent by scale alone."""
    paths = pages.select(page, F.posexplode(F.regexp_extract_all(F.col(svg), F.lit(SVG_PATH), F.lit(1))).alias("ordinal", "attrs"))
    attr = lambda pattern: F.regexp_extract("attrs", pattern, 1)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(SVG_NUMBER), F.lit(0)).cast("array<double>")
    paths = paths.select(page, "ordinal", rgb(attr(r'stroke="rgb\(([^)]*)\)"')).alias("colour"), attr(r'stroke-width="([0-9.]+)"').try_cast("double").alias("w"), numbers(attr(r'transform="matrix\(([^)]*)\)"')).alias("m"), numbers(attr(r'(?:^|\s)d="([^"]*)"')).alias("co"))
    # A filter would go below the numbers and read them a second time; a list of one or none is a filter that stays.
    paths = paths.withColumn("kept", F.explode(F.when((F.size("m") >= 6) & (F.size("co") >= 4), F.array(F.lit(True))))).drop("kept")
    n = F.floor(F.size("co") / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("co", i * 2).alias("x"), F.get("co", i * 2 + 1).alias("y")))
    paths = paths.withColumn("p", points)
    m = [F.get("m", F.lit(k)) for k in range(6)]
    xs, ys = F.transform("p", lambda p: m[0] * p["x"] + m[2] * p["y"] + m[4]), F.transform("p", lambda p: m[1] * p["x"] + m[3] * p["y"] + m[5])
    raw_w = F.array_max(F.transform("p", lambda p: p["x"])) - F.array_min(F.transform("p", lambda p: p["x"]))
    raw_h = F.array_max(F.transform("p", lambda p: p["y"])) - F.array_min(F.transform("p", lambda p: p["y"]))
    return paths.select(
        page, "ordinal", "colour", (F.col("w") * m[0]).alias("stroke_w"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), (raw_w * m[0]).alias("span_w"), (raw_h * m[0]).alias("span_h")
    )


def ink_points(pages: DataFrame, page: str = "page", svg: str = "svg") -> DataFrame:
    """(page, y) of every move and line of a page's source, transforms left out."""
    return pages.select(page, F.explode(F.regexp_extract_all(F.col(svg), F.lit(SVG_POINT), F.lit(1))).alias("y")).select(page, F.col("y").try_cast("double").alias("y"))


def ink_profile(points: DataFrame, page: str = "page", y: str = "y", bands: int = 10) -> DataFrame:
    """(page, points, bands): shares of ink in equal bands between a page's first and last ink. Bounds and counts are two aggregations of the same grouping, no window over rows."""
    ends = points.groupBy(page).agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count(F.lit(1)).alias("points"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    band = F.least(F.lit(bands - 1), F.floor((F.col(y) - F.col("lo")) / span * bands).cast("int"))
    counts = points.join(ends, page).groupBy(page, "points").agg(*(F.count_if(band == b).alias(f"n{b}") for b in range(bands)))
    return counts.select(page, F.col("points").cast("int").alias("points"), F.array(*(F.col(f"n{b}") / F.col("points") for b in range(bands))).alias("bands"))


def empty_profile(bands: int = 10) -> Column:
    """The profile of a page without ink."""
    return F.struct(F.lit(0).alias("points"), F.array(*[F.lit(0.0)] * bands).alias("bands"))


def is_blank(points: Column) -> Column:
    return points < BLANK_POINTS


def occupied_bands(bands: Column, threshold: float = 0.01) -> Column:
    return F.filter(F.transform(bands, lambda b, i: F.when(b >= threshold, i)), lambda i: i.isNotNull())


def ink_colours(ink: DataFrame, page: str = "page", width: str = "span_w", height: str = "span_h") -> DataFrame:
    """(page, colours): distinct colours of what isn't a guide line, most used first, of equals the one seen first. Pages without any have no row: unknown, not clean."""
    used = ink.where(F.col("colour").isNotNull() & ~is_rule(F.col(width), F.col(height))).groupBy(page, "colour").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", "colour")))
    return used.groupBy(page).agg(F.transform(ranked, lambda x: x["colour"]).alias("colours"))


def colour_histogram(ink: DataFrame, page: str = "page") -> DataFrame:
    return ink.where("colour is not null").groupBy(page, "colour").agg(F.count(F.lit(1)).alias("paths"))


def page_blocks(ink: DataFrame, page: str = "page", gap: float = BLOCK_GAP) -> DataFrame:
    """Ink in horizontal blocks, gaps and islands: (page, block, x, y, width, height, paths). A block starts where a stroke lies more than gap below all before it.

    Pages are dealt out to as many partitions as the input needs, so what a task sorts doesn't grow with the input.
    """
    w = Window.partitionBy(page).orderBy("y0")
    above = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = ink.where(~is_rule(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).select(page, "x0", "y0", "x1", "y1")
    if n := parts(ink, BYTES_SORTED):
        kept = kept.repartition(max(n, ink.sparkSession.sparkContext.defaultParallelism), page)
    starts = kept.withColumn("starts", F.coalesce((F.col("y0") - above > gap).cast("int"), F.lit(0)))
    islands = starts.withColumn("block", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = islands.groupBy(page, "block").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("y1") - F.min("y0")).alias("height"), F.count(F.lit(1)).alias("paths"))
    return out


def block_region(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A block in whole points: corners cut, sizes rounded up from a half."""
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), (width + 0.5).cast("int").alias("width"), (height + 0.5).cast("int").alias("height"))


def stroke_stats(ink: DataFrame, page: str = "page") -> DataFrame:
    """Per page: paths, median and mean stroke width, distinct colours."""
    kept = ink.where(~is_rule(F.col("span_w"), F.col("span_h")))
    return kept.groupBy(page).agg(F.count(F.lit(1)).alias("paths"), F.median("stroke_w").alias("median_w"), F.avg("stroke_w").alias("mean_w"), F.count_distinct("colour").alias("colours"))


def glyph_extent(ink: DataFrame, page: str = "page") -> DataFrame:
    """Per page: median height, the upper quartile by rank (not interpolated) and its ratio to the median stroke width."""
    kept = ink.where(~is_rule(F.col("span_w"), F.col("span_h")))
    rank = kept.withColumn("rn", F.row_number().over(Window.partitionBy(page).orderBy("span_h")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(page)))
    at = F.floor(F.col("n") * 0.75)
    out = rank.groupBy(page).agg(F.count(F.lit(1)).alias("paths"), F.median("stroke_w").alias("median_w"), F.median("span_h").alias("median_h"), F.max(F.when(F.col("rn") == at, F.col("span_h"))).alias("p75_h"))
    return out.withColumn("ratio", F.try_divide("p75_h", "median_w"))


def best_iou(boxes: DataFrame, blocks: DataFrame, page: str = "page") -> DataFrame:
    """(page, box_id, best): the best overlap of each box with a block of its page, 0 without blocks. Boxes and blocks of one page meet, nothing else; blocks are few a page, and ride along as one array."""
    from quillspark.functions.scalars import iou

    listed = blocks.groupBy(page).agg(F.collect_list(block_region(F.col("x"), F.col("y"), F.col("width"), F.col("height"))).alias("blocks"))
    best = F.array_max(F.transform(F.col("blocks"), lambda b: iou(F.col("box"), b)))
    return boxes.join(listed, page, "left").select(page, "box_id", F.coalesce(best, F.lit(0.0)).alias("best"))
