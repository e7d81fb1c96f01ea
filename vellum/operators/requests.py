"""Checks of requests and pages: parameters, sizes, budgets, modes and outcomes. All of it is one projection or one fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("ocr", "geometric", "auto", "auto_verified")


def boolean(text: Column) -> Column:
    """True, false, or null for what is neither."""
    low = F.lower(text)
    return F.when(low.isin("1", "true", "on", "yes"), True).when(low.isin("0", "false", "off", "no"), False)


def strict_integer(text: Column) -> Column:
    """Digits with a sign at most; null for anything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text).try_cast("int")


def size_verdict(width: Column, height: Column, max_side: int = 16384, max_pixels: int = 128_000_000) -> Column:
    """P31"""
    return F.when(F.greatest(width, height) > max_side, "dimension").when(width.cast("long") * height > max_pixels, "pixels").otherwise("ok")


def budget(items: DataFrame, limit: int) -> DataFrame:
    """slots of a batch that fit a pixel budget, in order. What doesn't fit uses nothing up, so this is a fold and no running sum."""
    batches = items.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("slot", "pixels"))).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<slot:bigint,fits:boolean>>)").alias("out"))
    fits = lambda acc, x: acc["used"] + x["pixels"] <= limit
    fold = F.aggregate("a", start, lambda acc, x: F.struct((acc["used"] + F.when(fits(acc, x), x["pixels"]).otherwise(F.lit(0))).alias("used"), F.array_append(acc["out"], F.struct(x["slot"].cast("long").alias("slot"), fits(acc, x).alias("fits"))).alias("out")))
    return batches.select("batch_id", F.explode(fold["out"]).alias("e")).select("batch_id", "e.slot", "e.fits")


def options(layout: Column, order: Column, blocks: Column, tables: Column, formulas: Column, text: Column) -> dict[str, Column]:
    """what options imply, and whether they conflict."""
    ordered = order | blocks
    return {"order": ordered, "layout": layout | ordered | tables | formulas, "conflict": ~text & (tables | formulas | ordered | ~layout)}


def structure_backends(wants_tables: Column, has_tables: Column, wants_formulas: Column, has_formulas: Column) -> Column:
    """the code of a request for what no backend is there for, or null; an override of routing is no backend."""
    return F.when(wants_tables & ~has_tables, "TABLE_BACKEND_DISABLED").when(wants_formulas & ~has_formulas, "FORMULA_BACKEND_DISABLED")


def pdf_request_error(pages: Column, dpi: Column, mode: Column, max_pages: int = 2000) -> Column:
    """The code of what is wrong with a request, or null."""
    return F.when(pages == 0, "EMPTY_PDF").when(pages > max_pages, "PDF_TOO_LARGE").when(~dpi.between(50, 600), "INVALID_DPI").when(~mode.isin(*MODES), "INVALID_PARAMETER")


def job_status(frame: DataFrame) -> DataFrame:
    """Outcome of a job by precedence; needs pages, timed_out, dropped, decode_failures, page_failures."""
    status = F.when(F.col("pages") == 0, "empty").when(F.col("timed_out"), "timed_out").when(F.col("dropped") > 0, "dropped").when(F.col("decode_failures") > 0, "decode_failed").when(F.col("page_failures") > 0, "page_failed").otherwise("ok")
    return frame.withColumn("status", status)


# Parameters by group.
PARAMETERS = {
    "options": ("layout", "reading_order", "as_blocks", "tables", "formulas", "text"),
    "routing": ("route_table", "route_formula"),
    "pixels": ("width", "height", "channels"),
    "pdf": ("dpi", "mode", "markdown", "as_pages", "images", "format", "lossless", "png_compression", "quality", "max_side", "autorotate"),
    "markdown": ("embed",),
}


def parameter_group(name: Column) -> Column:
    """The group of a parameter, or null if no endpoint knows it."""
    out = F.lit(None).cast("string")
    for group, names in PARAMETERS.items():
        out = F.when(name.isin(*names), group).otherwise(out)
    return out


def parameter_checks(given: DataFrame, endpoints: DataFrame, backends: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, error, ignored) of (request_id, endpoint, name, value).

    ``endpoints``: endpoint, groups (those it supports); routing overrides are refused where the group isn't supported, and must name one of ``backends``
    (parameter, backend) elsewhere. Other parameters that the endpoint doesn't support are errors if ``strict``; else those that some endpoint knows are listed as ignored.
    """
    rows = given.join(endpoints, "endpoint").withColumn("group", parameter_group(F.col("name")))
    supported = F.coalesce(F.array_contains("groups", F.col("group")), F.lit(False))
    override = (F.col("group") == "routing") & (F.coalesce("value", F.lit("")) != "")
    known = backends.select(F.col("parameter").alias("name"), F.col("backend").alias("value"), F.lit(True).alias("configured"))
    rows = rows.join(known, ["name", "value"], "left")
    fault = F.when(F.coalesce(F.col("group") != "routing", F.lit(True)) & ~supported & F.lit(strict), F.struct(F.lit(0).alias("rank"), F.lit("INVALID_PARAMETER").alias("code")))
    fault = fault.when(override & ~supported, F.struct(F.lit(1).alias("rank"), F.lit("INVALID_PARAMETER").alias("code")))
    fault = fault.when(override & F.col("configured").isNull(), F.struct(F.lit(2).alias("rank"), F.lit("ROUTING_UNKNOWN_OVERRIDE").alias("code")))
    ignored = F.when((F.col("group") != "routing") & ~supported & ~F.lit(strict), F.col("name"))
    return rows.groupBy("request_id").agg(F.min(fault)["code"].alias("error"), F.array_sort(F.collect_set(ignored)).alias("ignored"))


def degraded_summary(pages: DataFrame) -> DataFrame:
    """K7: ``text(p1,3); table(p2)`` for each document; needs doc_id, page_index and three flags."""
    parts = []
    for stage in ("text", "table", "formula"):
        numbers = F.array_sort(F.collect_list(F.when(F.col(f"{stage}_degraded"), F.col("page_index") + 1)))
        parts.append(F.when(F.size(numbers) > 0, F.concat(F.lit(f"{stage}(p"), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ","), F.lit(")"))))
    return pages.groupBy("doc_id").agg(F.concat_ws("; ", *parts).alias("degraded"))


def text_degraded(boxes: Column, results: Column, dropped: Column) -> tuple[Column, Column]:
    """(flag, message) of a page whose boxes gave no text, or some of whose crops were dropped."""
    none = (boxes > 0) & (results == 0)
    message = F.concat_ws("; ", F.when(none, F.format_string("%d regions gave no text", boxes)), F.when(dropped > 0, F.format_string("%d crops dropped", dropped)))
    return none | (dropped > 0), F.nullif(message, F.lit(""))


def stage_degraded(crops: DataFrame) -> DataFrame:
    """By page, crops whose reply is missing or empty."""
    bad = F.count_if(F.coalesce(F.trim("reply"), F.lit("")) == "")
    return crops.groupBy("page_id").agg(F.count("*").alias("n"), bad.alias("bad")).withColumns({"degraded": F.col("bad") > 0, "message": F.when(F.col("bad") > 0, F.format_string("%d of %d regions failed", F.col("bad"), F.col("n")))})
