"""Regions of pages and the lines in them: ownership, suppression, nesting and routing.

All joins have the page in their equality keys, so Spark plans hash or merge joins with the geometry as a residual condition and never a
nested loop. Chains of operators keep the hash partitioning by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import dims, geometry as g


def with_owner(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines with region_id, the first region, by number, that holds their centre; null for orphans. One aggregate picks it, map-side first, and keeps the
    lines' columns, so nothing is joined again; it isn't dealt anew where lines are dealt by page already. Its keys are all columns: give it those that are needed."""
    r = regions.select(F.col("page_id").alias("r_page"), F.col("region_id").alias("r_id"), *(F.col(k).alias(f"r_{k}") for k in ("x0", "y0", "x1", "y1")))
    inside = (F.col("page_id") == F.col("r_page")) & g.centre_inside(g.box(), g.box("r_"))
    return lines.join(r, inside, "left").groupBy(*lines.columns).agg(F.min("r_id").alias("region_id"))


def assign_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """The region of each line, or null."""
    return with_owner(lines.select("page_id", "line_id", "x0", "y0", "x1", "y1"), regions).select("page_id", "line_id", "region_id")


def supplementary_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions, and one more for the orphans of each page that has a region: their hull, score 1, the next number."""
    orphans = with_owner(lines.select("page_id", "line_id", "x0", "y0", "x1", "y1"), regions).where("region_id is null")
    hull = orphans.groupBy("page_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    numbers = regions.groupBy("page_id").agg(F.count("*").cast("int").alias("region_id"))
    extra = hull.join(numbers, "page_id").select("page_id", "region_id", F.lit(dims.SUPPLEMENTARY).alias("class_id"), F.lit(1000).alias("score_milli"), "x0", "y0", "x1", "y1")
    return regions.select(extra.columns).unionByName(extra)


def keep_confident(lines: DataFrame, least_milli: int = 500) -> DataFrame:
    """drops lines of low confidence and without text."""
    return lines.where((F.col("conf_milli") >= least_milli) & (F.col("text") != ""))


def decode_filter(boxes: DataFrame, width: int, height: int, floor_milli: int = 300, classes: int = 25) -> DataFrame:
    """F2: score floor, known classes, boxes cut to the page, empty ones dropped."""
    cut = boxes.where((F.col("score_milli") >= floor_milli) & F.col("class_id").between(0, classes - 1))
    for k, limit in (("x0", width), ("x1", width), ("y0", height), ("y1", height)):
        cut = cut.withColumn(k, F.greatest(F.lit(0), F.least(F.col(k), F.lit(limit))))
    return cut.where("x1 > x0 and y1 > y0")


def drop_oversized_images(regions: DataFrame, width: int, height: int, image_class: int = 14) -> DataFrame:
    """images over 82 hundredths of a page upright, or 93 of one on its side."""
    percent = 82 if height > width else 93
    return regions.where(~((F.col("class_id") == image_class) & (g.area(g.box()) * 100 > percent * width * height)))


def suppress(candidates: DataFrame, same_percent: int = 60, other_percent: int = 98) -> DataFrame:
    """Greedy suppression by falling score. A fold over each page's candidates in order: what is itself suppressed suppresses nothing."""
    entry = F.struct((-F.col("score_milli")).alias("s"), "cand_id", "class_id", "x0", "y0", "x1", "y1")
    pages = candidates.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("a"))
    fields = ("x0", "y0", "x1", "y1")

    def kills(k, x):
        shared = g.intersection_inclusive([k[f] for f in fields], [x[f] for f in fields])
        joined = g.area_inclusive([k[f] for f in fields]) + g.area_inclusive([x[f] for f in fields]) - shared
        return shared * 100 >= joined * F.when(k["class_id"] == x["class_id"], F.lit(same_percent)).otherwise(F.lit(other_percent))

    kept = F.aggregate("a", F.slice("a", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: kills(k, x)), acc).otherwise(F.array_append(acc, x)))
    return pages.select("page_id", F.explode(kept).alias("e")).select("page_id", "e.cand_id")


def nesting(regions: DataFrame, id_column: str = "region_id", percent: int = 90) -> DataFrame:
    """Whether a region lies in another one, and whether it holds one. Formulas count only against formulas."""
    a, b = regions.alias("a"), regions.alias("b")
    fields = ("x0", "y0", "x1", "y1")
    ba, bb = [F.col(f"a.{k}") for k in fields], [F.col(f"b.{k}") for k in fields]
    formula = lambda x: F.col(f"{x}.class_id").isin(*dims.FORMULAS)
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col(f"a.{id_column}") != F.col(f"b.{id_column}")) & (formula("a") == formula("b")) & (g.intersection_inclusive(ba, bb) * 100 >= g.area_inclusive(ba) * percent))
    inner = pairs.select(F.col("a.page_id").alias("page_id"), F.col(f"a.{id_column}").alias(id_column), F.lit(1).alias("inside"), F.lit(0).alias("holds"))
    outer = pairs.select(F.col("b.page_id").alias("page_id"), F.col(f"b.{id_column}").alias(id_column), F.lit(0).alias("inside"), F.lit(1).alias("holds"))
    flags = inner.unionByName(outer).groupBy("page_id", id_column).agg(F.max("inside").alias("inside"), F.max("holds").alias("holds"))
    return regions.join(flags, ["page_id", id_column], "left").withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in ("inside", "holds")})


def reconcile_nested(regions: DataFrame, keep: str = "outer", id_column: str = "region_id", percent: int = 90) -> DataFrame:
    """Keeps all regions, the outer ones, or the inner ones of nested pairs."""
    if keep == "all":
        return regions
    flagged = nesting(regions, id_column, percent)
    wanted = (F.col("inside") == 0) if keep == "outer" else (F.col("holds") == 0) | (F.col("inside") == 1)
    return flagged.where(wanted).select(*regions.columns)


def region_statistics(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Number of lines by their first region, their area in it as a share of its own (1 at most) in thousandths, and their mean shape."""
    owned = with_owner(lines.select("page_id", "line_id", "x0", "y0", "x1", "y1"), regions).where("region_id is not null")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sums = owned.groupBy("page_id", "region_id").agg(F.count("*").alias("n_lines"), F.sum(w.cast("long") * h).alias("covered"), F.sum(F.when((w > 0) & (h > 0), F.floor(w * 1000 / h)).otherwise(0)).alias("shape_sum"))
    own = g.area(g.box())
    out = regions.join(sums, ["page_id", "region_id"], "left")
    n = F.coalesce("n_lines", F.lit(0))
    return out.select(
        *regions.columns, n.alias("n_lines"),
        F.when(own > 0, F.least(F.lit(1000), F.floor(F.coalesce("covered", F.lit(0)) * 1000 / own))).otherwise(0).cast("long").alias("coverage_milli"),
        F.when(n > 0, F.floor(F.col("shape_sum") / n)).otherwise(0).cast("long").alias("shape_milli"),
        F.least(F.lit(1.0), n / F.log1p(F.greatest(F.lit(1), own))).alias("symbol_density"),
    )


def tie_breaks(regions: DataFrame) -> DataFrame:
    """Regions that lose an overlap: (page, region, reason), the reason of the first pair in order of numbers in which they lose.

    Containment of four fifths takes the outer region unless it is a table; else an overlap of three to eight tenths goes by class priority,
    score beyond a hundredth, area and number.
    """
    ranked = dims.with_class(regions, "priority")
    a, b = ranked.alias("a"), ranked.alias("b")
    fields = ("x0", "y0", "x1", "y1")
    ba, bb = [F.col(f"a.{k}") for k in fields], [F.col(f"b.{k}") for k in fields]
    shared = g.intersection(ba, bb)
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.region_id") < F.col("b.region_id")) & (shared > 0))
    aa, ab = g.area(ba), g.area(bb)
    outer_a, outer_b = (shared * 100 >= ab * 80) & (aa > ab), (shared * 100 >= aa * 80) & (ab > aa)
    union = aa + ab - shared
    middle = (shared * 100 >= union * 30) & (shared * 100 <= union * 80)
    pa, pb, sa, sb = F.col("a.priority"), F.col("b.priority"), F.col("a.score_milli"), F.col("b.score_milli")
    b_loses = F.when(pa != pb, pa > pb).when(F.abs(sa - sb) > 10, sa > sb).when(aa != ab, aa > ab).otherwise(True)
    first, second = F.col("a.region_id"), F.col("b.region_id")
    table = lambda x: F.col(f"{x}.class_id") == 21
    loser = F.when(outer_a, F.when(~table("a"), first)).when(outer_b, F.when(~table("b"), second)).when(middle, F.when(b_loses, second).otherwise(first))
    # The pair's numbers and the reason in one number, which a hash aggregate takes the least of.
    at = F.shiftleft(first.cast("long"), 32) + F.shiftleft(second.cast("long"), 1) + F.when(outer_a | outer_b, 0).otherwise(1)
    lost = pairs.select(F.col("a.page_id").alias("page_id"), loser.alias("region_id"), at.alias("at")).where("region_id is not null")
    return lost.groupBy("page_id", "region_id").agg(F.min("at").alias("at")).select("page_id", "region_id", F.when(F.col("at") % 2 == 0, "containment").otherwise("overlap").alias("reason"))


def route(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Destination of each region, with tier, formula wrap and reason.

    R2: class default; charts with two lines or more and images with three on 15 hundredths of their area become text; the lowest tier demotes;
    R3: flat or thin text regions of few, dense lines become formulas on pages that have a confident one; J6 comes last.
    """
    stats = dims.with_class(region_statistics(lines, regions), "destination", "trust_milli", "verify_milli")
    formula = (F.col("class_id").isin(*dims.FORMULAS)) & (F.col("score_milli") >= F.col("trust_milli"))
    page = Window.partitionBy("page_id")
    # Line statistics exist only on pages that have a class which needs them.
    gate = F.max(F.col("class_id").isin(3, 5, 14, 15, 21)).over(page)
    stats = stats.withColumns({"formulas": F.max(formula).over(page), "gate": gate, "tier": dims.tier(F.col("score_milli"))})
    passed = F.col("gate") & (((F.col("class_id") == 3) & (F.col("n_lines") >= 2)) | ((F.col("class_id") == 14) & (F.col("n_lines") >= 3) & (F.col("coverage_milli") >= 150)))
    dest = F.when(passed, "text").otherwise(F.col("destination"))
    low = F.col("tier") == "fallback"
    wrap = F.when(F.col("class_id") == 5, "display").when(F.col("class_id") == 15, "inline").otherwise("none")
    reason = (
        F.when(low & (dest == "table"), "table_fallback").when(low & (dest == "formula"), "formula_fallback").when(low & (dest == "skip"), "passthrough")
        .when(passed, "passthrough").when(F.col("class_id") == dims.SUPPLEMENTARY, "supplementary").otherwise("class_default")
    )
    first = stats.withColumns({"wrap": F.when(low & (dest == "formula"), "none").otherwise(wrap), "reason": reason, "dest": F.when(low, "text").otherwise(dest)})
    shape = (F.col("shape_milli") >= 6000) | ((F.col("shape_milli") > 0) & (F.col("shape_milli") * 6 <= 1000))
    salvage = F.col("formulas") & F.col("gate") & (F.col("dest") == "text") & (F.col("class_id") == 22) & (F.col("n_lines") <= 3) & shape & (F.col("symbol_density") > 0.4)
    second = first.select("page_id", "region_id", "tier", F.when(salvage, "formula").otherwise(F.col("dest")).alias("dest"), F.when(salvage, "inline").otherwise(F.col("wrap")).alias("wrap"), F.when(salvage, "formula_salvage").otherwise(F.col("reason")).alias("reason"), salvage.alias("also_text"))
    lost = tie_breaks(regions).withColumnRenamed("reason", "lost")
    hit = F.col("lost").isNotNull() & (F.col("dest") != "text")
    return second.join(lost, ["page_id", "region_id"], "left").select(
        "page_id", "region_id", "tier", F.when(hit, "text").otherwise(F.col("dest")).alias("dest"), F.when(hit, "none").otherwise(F.col("wrap")).alias("wrap"),
        F.when(hit, F.concat(F.col("lost"), F.lit("_loser"))).otherwise(F.col("reason")).alias("reason"), "also_text",
    )


def verified_route(routed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What a classifier of tables says of the tables whose tier asks for it: (page_id, region_id, is_table, kind). Those that are none become text; others
    take its kind as a hint. Tables without a verdict, and all other regions, stay as they are."""
    asked = (F.col("dest") == "table") & (F.col("tier") == "verify")
    joined = routed.join(verdicts.select("page_id", "region_id", "is_table", F.col("kind").alias("hint")), ["page_id", "region_id"], "left").withColumn("asked", asked & F.col("is_table").isNotNull())
    demoted = F.col("asked") & ~F.col("is_table")
    return joined.select(
        "page_id", "region_id", "tier", F.when(demoted, "text").otherwise(F.col("dest")).alias("dest"), F.when(demoted, "none").otherwise(F.col("wrap")).alias("wrap"),
        F.when(demoted, "table_verify_demoted").otherwise(F.col("reason")).alias("reason"), F.when(F.col("asked") & F.col("is_table"), F.col("hint")).alias("hint"),
    )


def suppressed_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """R1, last step: lines that a table or formula owns are not recognised as text, unless it is read both ways."""
    owner = assign_regions(lines, regions)
    plan = route(lines, regions).select("page_id", "region_id", "dest", "also_text")
    return owner.join(plan, ["page_id", "region_id"], "left").select("page_id", "line_id", "region_id", F.coalesce(F.col("dest").isin("table", "formula") & ~F.col("also_text"), F.lit(False)).alias("suppressed"))
