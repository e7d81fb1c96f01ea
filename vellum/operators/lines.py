"""Text lines of pages: order, clustering into rows, direction, statistics and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as g
from vellum.operators.layout import keep_confident, with_owner


def band_order(lines: DataFrame, band: int = 10) -> DataFrame:
    """Position by bands of ten pixels, then from left to right; equals keep their order."""
    by = Window.partitionBy("page_id").orderBy(F.floor(F.col("y0") / band), "x0", "line_id")
    return lines.withColumn("position", F.row_number().over(by))


def page_order(lines: DataFrame) -> DataFrame:
    """By the centres' heights, then from left to right; the order of pages without a layout."""
    by = Window.partitionBy("page_id").orderBy(F.col("y0") + F.col("y1"), F.col("x0") + F.col("x1"), "line_id")
    return lines.withColumn("position", F.row_number().over(by))


def row_tolerance(owned: DataFrame) -> DataFrame:
    """Of each region, a third of the upper median height of its lines, four at least; eight where it has one line."""
    heights = F.sort_array(F.collect_list(F.greatest(F.lit(1), F.col("y1") - F.col("y0"))))
    out = owned.groupBy("page_id", "region_id").agg(heights.alias("h"))
    middle = F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int"))
    return out.select("page_id", "region_id", F.when(F.size("h") < 2, 8).otherwise(F.greatest(F.lit(4), F.floor(middle / 3))).cast("int").alias("tolerance"))


def row_order(owned: DataFrame) -> DataFrame:
    """Place of a line in its region: rows by the tolerance, then from left to right."""
    ready = owned.join(row_tolerance(owned), ["page_id", "region_id"])
    row = F.floor(F.floor((F.col("y0") + F.col("y1")) / 2) / F.col("tolerance"))
    by = Window.partitionBy("page_id", "region_id").orderBy(row, F.col("x0") + F.col("x1"), "line_id")
    return ready.withColumn("position", F.row_number().over(by))


def direction_vote(owned: DataFrame) -> DataFrame:
    """A4: regions are horizontal if half of their lines are."""
    return owned.groupBy("page_id", "region_id").agg(F.count("*").alias("n"), F.count_if(g.is_horizontal(g.box())).alias("horizontal")).withColumn("is_horizontal", F.col("horizontal") * 2 >= F.col("n"))


def page_direction(owned: DataFrame, regions: DataFrame) -> DataFrame:
    """A4 for pages: the vote of its text regions; horizontal where it has none."""
    votes = regions.where("class_id = 22").join(direction_vote(owned), ["page_id", "region_id"], "left")
    text = votes.groupBy("page_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("is_horizontal", F.lit(True))).alias("horizontal"))
    return regions.select("page_id").distinct().join(text, "page_id", "left").select("page_id", F.coalesce(F.col("horizontal") * 2 >= F.col("total"), F.lit(True)).alias("is_horizontal"))


def cluster_rows(owned: DataFrame, percent: int = 60) -> DataFrame:
    """G1, A5: lines of a region gathered into rows, and the rows' figures.

    Lines come by their upper edge; one joins the current row if it shares ``percent`` of the shorter height with the row's hull. The hull grows, so this is a fold
    over the region's lines in order and not a comparison with the line before.
    """
    entry = F.struct("y0", "line_id", "x0", "x1", "y1")
    groups = owned.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(entry)).alias("a"))
    fields = ("x0", "y0", "x1", "y1")
    row = lambda e: F.struct(*(e[k].cast("int").alias(k) for k in fields))

    def step(acc, e):
        last = F.element_at(acc, -1)
        shared, shorter = g.overlap_small(last["y0"], last["y1"], e["y0"], e["y1"])
        grown = F.struct(F.least(last["x0"], e["x0"]).cast("int").alias("x0"), F.least(last["y0"], e["y0"]).cast("int").alias("y0"), F.greatest(last["x1"], e["x1"]).cast("int").alias("x1"), F.greatest(last["y1"], e["y1"]).cast("int").alias("y1"))
        joins = (F.size(acc) > 0) & (shorter > 0) & (shared * 100 >= shorter * percent)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(grown))).otherwise(F.concat(acc, F.array(row(e))))

    start = F.expr("cast(array() as array<struct<x0:int,y0:int,x1:int,y1:int>>)")
    rows = groups.select("page_id", "region_id", F.aggregate("a", start, step).alias("r"))
    total = lambda f: F.aggregate("r", F.lit(0).cast("long"), lambda s, e: s + f(e))
    n = F.size("r")
    return rows.select(
        "page_id", "region_id", n.alias("n_rows"), F.floor(total(lambda e: e["y1"] - e["y0"]) / n).alias("row_height"), F.floor(total(lambda e: e["x1"] - e["x0"]) / n).alias("row_width"),
        F.element_at("r", 1)["x0"].alias("starts_at"), F.element_at("r", -1)["x1"].alias("ends_at"),
    )


def page_row_size(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean row height and width over a page's text regions."""
    text = rows.join(regions.where("class_id = 22").select("page_id", "region_id"), ["page_id", "region_id"]).where("row_height > 0")
    return text.groupBy("page_id").agg(F.floor(F.sum("row_width") / F.count("*")).alias("row_width"), F.floor(F.sum("row_height") / F.count("*")).alias("row_height"))


def matched_pages(lines: DataFrame, owner: DataFrame) -> DataFrame:
    """Whether five hundredths of a page's lines, one at least, lie in regions."""
    return owner.groupBy("page_id").agg(F.count("*").alias("n"), F.count("region_id").alias("matched")).withColumn("enough", F.col("matched") >= F.greatest(F.lit(1), F.floor((F.col("n") * 5 + 99) / 100)))


def projection(boxes: DataFrame, low: str, high: str) -> DataFrame:
    """How many boxes cover each place on an axis. Changes are summed up at edges, so a box is two rows whatever its length."""
    changes = boxes.select("page_id", F.col(low).alias("at"), F.lit(1).alias("change")).unionByName(boxes.select("page_id", F.col(high).alias("at"), F.lit(-1).alias("change"))).groupBy("page_id", "at").agg(F.sum("change").alias("change"))
    by = Window.partitionBy("page_id").orderBy("at")
    covered = changes.select("page_id", F.col("at").alias("from"), F.lead("at").over(by).alias("to"), F.sum("change").over(by).alias("boxes"))
    return covered.where("to is not null and boxes > 0")


def gaps(boxes: DataFrame, low: str, high: str, min_gap: int = 1) -> DataFrame:
    """Islands of boxes on an axis: a box starts a new one if it begins more than ``min_gap`` after the furthest end before it."""
    by = Window.partitionBy("page_id").orderBy(low, high, "region_id")
    real = boxes.where(F.col(high) > F.col(low))
    furthest = F.max(high).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = real.withColumn("starts", F.when(furthest.isNull() | (F.col(low) - furthest + 1 > min_gap), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("starts").over(by))
    return numbered.groupBy("page_id", "island").agg(F.min(low).alias("from"), F.max(high).alias("to"), F.count("*").alias("boxes"))


def join_text(ordered: DataFrame, keys: tuple[str, ...] = ("page_id", "region_id")) -> DataFrame:
    """A10: texts of a block in order. A space joins a line to one on its own band, or to one that reached the right edge; else a line feed does."""
    by = Window.partitionBy(*keys).orderBy("position")
    middle, height = F.col("y0") + F.col("y1"), F.col("y1") - F.col("y0")
    same_band = F.abs(middle - F.lag(middle).over(by)) <= height
    full = F.lag("x1").over(by) >= F.col("block_x1") - F.greatest(F.lit(8), height)
    lead = F.when(F.row_number().over(by) == 1, "").when(same_band | full, " ").otherwise("\n")
    parts = ordered.withColumn("part", F.concat(lead, F.col("text")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda e: e["part"]), "").alias("content"), F.count("*").alias("n_lines"))


def paragraph_blocks(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """The text of every region that has lines, in order of bucket and place."""
    from vellum.functions import dims

    good = keep_confident(lines)
    owned = with_owner(good, regions).where("region_id is not null")
    edges = regions.select("page_id", "region_id", "class_id", F.col("x0").alias("block_x0"), F.col("y0").alias("block_y0"), F.col("x1").alias("block_x1"))
    ordered = row_order(owned).join(edges, ["page_id", "region_id"])
    blocks = join_text(ordered).join(dims.with_class(edges, "label", "bucket"), ["page_id", "region_id"])
    by = Window.partitionBy("page_id").orderBy("bucket", "block_y0", "block_x0", "region_id")
    return blocks.select("page_id", F.row_number().over(by).alias("block"), "region_id", "label", "n_lines", "content")
