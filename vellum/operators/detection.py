"""Boxes that detectors give: order of corners, crops and their transforms, and what is too small or too uncertain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_quad(xs: list[Column], ys: list[Column]) -> Column:
    """Corners as top left, top right, bottom right, bottom left: by x, equals in their order, then by y in each half."""
    corners = F.array_sort(F.array(*(F.struct(x.alias("x"), F.lit(k).alias("k"), y.alias("y")) for k, (x, y) in enumerate(zip(xs, ys)))))
    p = [F.element_at(corners, k + 1) for k in range(4)]
    left, right = p[0]["y"] < p[1]["y"], p[2]["y"] < p[3]["y"]
    point = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))
    pick = lambda test, a, b: F.when(test, point(a)).otherwise(point(b))
    return F.array(pick(left, p[0], p[1]), pick(right, p[2], p[3]), pick(right, p[3], p[2]), pick(left, p[1], p[0]))


def crop_width(xs: list[Column], ys: list[Column], height: int, most: int) -> tuple[Column, Column]:
    """(width of a line's crop at that height, whether the line is turned); widths are rounded up."""
    side = lambda a, b: F.sqrt(((xs[a] - xs[b]) * (xs[a] - xs[b]) + (ys[a] - ys[b]) * (ys[a] - ys[b])).cast("double"))
    w, h = side(0, 1), side(0, 3)
    turned = h >= w * 1.5
    long, short = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.when(short > 0, long / short * height).otherwise(0)).cast("int"))), turned


def perspective(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> list[float]:
    """The nine numbers of the map that takes target corners to source corners."""
    import numpy as np

    rows, right = [], []
    for (u, v), (x, y) in zip(target, source):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    try:
        return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]
    except np.linalg.LinAlgError:
        return [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def with_transform(quads: DataFrame, height: int = 48, most: int = 3200) -> DataFrame:
    """Width of each line's crop, and the nine numbers of the map that takes the crop's corners to those of its quad (qx0 to qy3, in turn); a quad without area gets the identity.

    The map of the unit square is in closed form, so it is an expression; the crop's size scales its columns.
    """
    x, y = [F.col(f"qx{k}").cast("double") for k in range(4)], [F.col(f"qy{k}").cast("double") for k in range(4)]
    width, _ = crop_width(x, y, height, most)
    skew = lambda v: v[0] - v[1] + v[2] - v[3]
    area = (x[1] - x[2]) * (y[3] - y[2]) - (x[3] - x[2]) * (y[1] - y[2])
    across = (skew(x) * (y[3] - y[2]) - (x[3] - x[2]) * skew(y)) / F.nullif(area, F.lit(0.0))
    down = ((x[1] - x[2]) * skew(y) - skew(x) * (y[1] - y[2])) / F.nullif(area, F.lit(0.0))
    w, h = F.col("width"), F.lit(float(height))
    out = quads.withColumns({"width": width, "across": across, "down": down})
    row = lambda v: [(v[1] - v[0] + F.col("across") * v[1]) / w, (v[3] - v[0] + F.col("down") * v[3]) / h, v[0]]
    matrix = F.array(*row(x), *row(y), F.col("across") / w, F.col("down") / h, F.lit(1.0))
    return out.withColumn("matrix", F.when(F.col("across").isNull(), F.array(*(F.lit(float(k % 4 == 0)) for k in range(9)))).otherwise(matrix)).withColumn("height", h).drop("across", "down")


def maps_corners(margin: float = 1e-6) -> Column:
    """Whether ``matrix`` takes the corners of a crop of that width and height to those of the quad, or is the identity."""
    m = [F.get("matrix", F.lit(k)) for k in range(9)]
    good = F.lit(True)
    for k, (u, v) in enumerate(((F.lit(0.0), F.lit(0.0)), (F.col("width"), F.lit(0.0)), (F.col("width"), F.col("height")), (F.lit(0.0), F.col("height")))):
        scale = m[6] * u + m[7] * v + m[8]
        for q, at in ((f"qx{k}", 0), (f"qy{k}", 3)):
            good = good & (F.abs((m[at] * u + m[at + 1] * v + m[at + 2]) / scale - F.col(q)) < margin)
    return good | ((m[0] == 1) & (m[4] == 1) & (m[2] == 0) & (m[5] == 0))


def keep_candidates(candidates: DataFrame, least_side: float = 3.0, least_score: float = 0.6, least_unclipped: float = 5.0, most: int = 3000) -> DataFrame:
    """Of the first ``most`` candidates of a page, those of enough points, size and score; needs points, width, height, side, score and unclipped."""
    from pyspark.sql import Window

    first = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("cand_id"))).where(F.col("rank") <= most).drop("rank")
    return first.where((F.col("points") > 2) & (F.col("width") >= 3) & (F.col("height") >= 3) & (F.col("side") >= least_side) & (F.col("score") >= least_score) & (F.col("unclipped") >= least_unclipped))


def table_crop(tables: DataFrame, lines: DataFrame, snap: bool = False, margin_percent: int = 3) -> DataFrame:
    """(page_id, region_id, box): the region, cut to the hull of its lines if asked, and a margin around it."""
    box = {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}
    if snap:
        t = tables.select("page_id", "region_id", *(F.col(k).alias(f"t_{k}") for k in box))
        middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
        inside = lines.join(t, "page_id").where(middle("x0", "x1").between(F.col("t_x0"), F.col("t_x1")) & middle("y0", "y1").between(F.col("t_y0"), F.col("t_y1")))
        hull = inside.groupBy("page_id", "region_id").agg(F.min("x0").alias("h_x0"), F.min("y0").alias("h_y0"), F.max("x1").alias("h_x1"), F.max("y1").alias("h_y1"))
        tables = tables.join(hull, ["page_id", "region_id"], "left")
        cut = {"x0": F.greatest("x0", "h_x0"), "y0": F.greatest("y0", "h_y0"), "x1": F.least("x1", "h_x1"), "y1": F.least("y1", "h_y1")}
        real = F.col("h_x0").isNotNull() & (cut["x1"] > cut["x0"]) & (cut["y1"] > cut["y0"])
        tables = tables.select("page_id", "region_id", *(F.when(real, cut[k]).otherwise(F.col(k)).alias(k) for k in box))
    wide, high = F.floor((F.col("x1") - F.col("x0")) * margin_percent / 100).cast("int"), F.floor((F.col("y1") - F.col("y0")) * margin_percent / 100).cast("int")
    return tables.select("page_id", "region_id", (F.col("x0") - wide).alias("x0"), (F.col("y0") - high).alias("y0"), (F.col("x1") + wide).alias("x1"), (F.col("y1") + high).alias("y1"))


def png_size(content: Column) -> tuple[Column, Column]:
    """(width, height) from the first bytes of a PNG; null for what is none."""
    head = F.hex(F.substring(content, 1, 24))
    is_png = F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.substring(head, 25, 8) == "49484452")
    number = lambda at: F.when(is_png, F.conv(F.substring(head, at, 8), 16, 10).cast("int"))
    return number(33), number(41)
