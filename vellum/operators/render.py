"""Pages as Markdown and JSON: ordered parts, templates by class, and the joins that bring payloads to regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import dims, geometry as g
from vellum.functions import text as t

# Labels that Markdown leaves out, images, and labels whose text must have two characters.
IGNORED = ("header", "header_image", "footer", "footer_image", "number", "seal")
IMAGES = ("image", "chart", "header_image", "footer_image", "seal")
GATED = ("text", "content", "abstract", "aside_text", "footnote", "vision_footnote", "vertical_text", "reference", "reference_content", "number", dims.SUPPLEMENTARY_LABEL)


def last_payload(payloads: DataFrame, value: str) -> DataFrame:
    """Of several payloads of a region, the last."""
    return payloads.groupBy("page_id", "region_id").agg(F.max_by(value, "seq").alias(value))


def formula_tags(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Each formula number to the nearest display formula whose height range holds its centre: (page_id, formula, number, tag)."""
    n = regions.where("class_id = 11").select("page_id", F.col("region_id").alias("number"), F.col("x0").alias("n_x0"), F.floor((F.col("y0") + F.col("y1")) / 2).alias("middle"))
    f = regions.where("class_id = 5").select("page_id", F.col("region_id").alias("formula"), "x1", "y0", "y1")
    near = n.join(f, "page_id").where("middle between y0 and y1").groupBy("page_id", "number").agg(F.min_by("formula", F.struct(F.abs(F.col("n_x0") - F.col("x1")).alias("d"), F.col("formula").alias("f"))).alias("formula"))
    tagged = near.join(texts.select("page_id", F.col("region_id").alias("number"), t.clean_tag(F.col("text")).alias("tag")), ["page_id", "number"]).where("tag <> ''")
    return tagged


def nearest_line(regions: DataFrame, lines: DataFrame, value: str = "line_id") -> DataFrame:
    """For each region, the line with the nearest centre, or its ``value``: (page_id, region_id, value). Pages are keyed, so pairs stay within one."""
    r = regions.select("page_id", "region_id", (F.col("x0") + F.col("x1")).alias("rx"), (F.col("y0") + F.col("y1")).alias("ry"))
    dx, dy = (F.col("x0") + F.col("x1") - F.col("rx")).cast("long"), (F.col("y0") + F.col("y1") - F.col("ry")).cast("long")
    return r.join(lines.select("page_id", "line_id", F.col(value).alias("_value"), "x0", "y0", "x1", "y1"), "page_id").groupBy("page_id", "region_id").agg(F.min_by("_value", F.struct((dx * dx + dy * dy).alias("d"), "line_id")).alias(value))


def line_ranks(lines: DataFrame, ordered: DataFrame | None = None) -> DataFrame:
    """Place of each line: those in reading order first, others by (y, x). Lines may have their place themselves."""
    joined = lines if ordered is None else lines.join(ordered.select("page_id", "line_id", "place"), ["page_id", "line_id"], "left")
    by = Window.partitionBy("page_id").orderBy(F.col("place").isNull(), F.coalesce("place", F.lit(0)), "y0", "x0", "line_id")
    return joined.withColumn("rank", F.row_number().over(by) - 1).drop("place")


def region_texts(ranked: DataFrame) -> DataFrame:
    """Trimmed lines of a region in order, joined by spaces: (page_id, region_id, text, first)."""
    own = ranked.where("region_id is not null")
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: t.trim(e["text"])), lambda x: x != "")
    return own.groupBy("page_id", "region_id").agg(F.array_join(parts, " ").alias("text"), F.min("rank").alias("first"))


def without_layout(lines: DataFrame, least: int = 2) -> DataFrame:
    """M2: pages without regions: one paragraph a line."""
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda e: t.trim(e["text"])), lambda x: F.char_length(x) >= least)
    md = F.array_join(parts, "\n\n")
    return lines.groupBy("page_id").agg(md.alias("md")).select("page_id", F.when(F.col("md") == "", "").otherwise(F.concat("md", F.lit("\n"))).alias("markdown"))


def block_image(page: Column, region: Column) -> Column:
    """The name under which Markdown links to a region's image unless a caller says otherwise."""
    return F.concat(F.lit("block"), region.cast("string"), F.lit(".png"))


def markdown_parts(regions: DataFrame, ranked: DataFrame, tables: DataFrame, formulas: DataFrame, image_source: Callable[[Column, Column], Column] = block_image) -> DataFrame:
    """The Markdown of every region that has any, and its place on the page.

    ``ranked`` has lines with rank and region_id; ``tables`` and ``formulas`` have page_id, region_id, seq and html or latex. E3: ``image_source`` makes an
    image's address of the columns page_id and region_id.
    """
    texts = region_texts(ranked)
    tags = formula_tags(regions, texts)
    tag_of = tags.groupBy("page_id", F.col("formula").alias("region_id")).agg(F.max_by("tag", "number").alias("tag"))
    used = tags.select("page_id", F.col("number").alias("region_id")).distinct().withColumn("used", F.lit(True))
    keys = ["page_id", "region_id"]
    # Regions with lines of their own go by the first of them.
    near = nearest_line(regions.join(texts, keys, "left_anti"), ranked, "rank").select("page_id", "region_id", (F.col("rank") + 0.5).alias("near"))
    full = dims.with_class(regions, "label", "bucket")
    for extra in (texts, last_payload(tables, "html"), last_payload(formulas, "latex"), tag_of, used, near):
        full = full.join(extra, keys, "left")
    text, latex, html = F.coalesce("text", F.lit("")), t.trim(F.coalesce("latex", F.lit(""))), t.table_part(F.coalesce("html", F.lit("")))
    math = F.when(latex == "", text).otherwise(latex)
    known = F.col("latex").isNotNull()
    c = F.col("class_id")
    label = F.col("label")
    display = F.concat(F.lit("$$\n"), math, F.coalesce(F.concat(F.lit(" \\tag{"), F.col("tag"), F.lit("}")), F.lit("")), F.lit("\n$$"))
    short = label.isin(*GATED) & (F.char_length(text) < 2)
    plain = (
        F.when((text == "") | short, "").when(label == "doc_title", F.concat(F.lit("# "), text)).when(label == "paragraph_title", F.concat(F.lit("## "), text))
        .when(label == "figure_title", F.concat(F.lit("### "), text)).when(label == "abstract", F.concat(F.lit("**Abstract** "), text))
        .when(label == "algorithm", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(label.isin("reference", "reference_content"), F.concat(F.lit("- "), text)).otherwise(text)
    )
    part = (
        F.when(F.col("used") | label.isin(*IGNORED) | (c == 11), "").when(c == 21, F.when(html != "", html).otherwise(text))
        .when(c == 5, F.when(~known, text).when(math == "", "").otherwise(display)).when(c == 15, F.when(~known, text).when(math == "", "").otherwise(F.concat(F.lit("$"), math, F.lit("$"))))
        .when(label.isin(*IMAGES), F.concat(F.lit("!["), t.link_escape(text), F.lit("]("), image_source(F.col("page_id"), F.col("region_id")), F.lit(")"))).otherwise(plain)
    )
    order = Window.partitionBy("page_id").orderBy("bucket", "key", "y0", "x0", "region_id")
    placed = full.select("page_id", "region_id", "bucket", "y0", "x0", "label", F.coalesce(F.col("first").cast("double"), F.col("near"), F.lit(1e9) + F.col("y0")).alias("key"), F.coalesce(part, F.lit("")).alias("part")).where("part <> ''")
    placed = placed.withColumn("place", F.row_number().over(order))
    is_reference = F.col("label").isin("reference", "reference_content")
    first_reference = is_reference & (F.sum(is_reference.cast("int")).over(order) == 1)
    return placed.select("page_id", "region_id", "place", F.when(first_reference, F.concat(F.lit("### References\n\n"), F.col("part"))).otherwise(F.col("part")).alias("part"))


def markdown(parts: DataFrame) -> DataFrame:
    """M1: a page's parts in order, parted by empty lines."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda e: e["part"]), "\n\n")
    return parts.groupBy("page_id").agg(F.concat(joined, F.lit("\n")).alias("markdown"))


def assets(regions: DataFrame, image_source: Callable[[Column, Column], Column] = block_image) -> DataFrame:
    """A row for each image that Markdown links to."""
    named = dims.with_class(regions, "label").where(F.col("label").isin(*[x for x in IMAGES if x not in IGNORED]))
    return named.select("page_id", "region_id", F.col("label").alias("kind"), image_source(F.col("page_id"), F.col("region_id")).alias("path"), "x0", "y0", "x1", "y1")


def document_markdown(pages: DataFrame, per_document: int) -> DataFrame:
    """K6: pages of a document behind their numbers."""
    numbered = pages.select(F.floor(F.col("page_id") / per_document).alias("doc_id"), (F.col("page_id") % per_document).alias("page"), "markdown")
    part = F.concat(F.lit("<!-- page "), (F.col("page") + 1).cast("string"), F.lit(" -->\n\n"), F.col("markdown"))
    return numbered.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))), lambda e: e["part"]), "\n\n").alias("markdown"))


def page_json(owned: DataFrame, regions: DataFrame) -> DataFrame:
    """K1, K3, K4: a page, of lines with their region_id, as JSON: results, and layout if it has any; fields that are null are left out."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    quad = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    item = F.struct(F.col("line_id").alias("id"), "text", (F.col("conf_milli") / 1000).alias("confidence"), quad.alias("bounding_box"), F.col("region_id").alias("layout_id"))
    results = owned.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    box = F.struct(F.col("region_id").alias("id"), F.col("label").alias("class"), "class_id", (F.col("score_milli") / 1000).alias("confidence"), quad.alias("bounding_box"))
    layout = dims.with_class(regions, "label").groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("layout"))
    return results.join(layout, "page_id", "left").select("page_id", F.to_json(F.struct("results", "layout"), {"ignoreNullFields": "true"}).alias("json"))


def batch_json(slots: DataFrame) -> DataFrame:
    """Batches with results and errors aligned by slot."""
    rows = slots.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("slot", "text", "error"))).alias("a"))
    return rows.select("batch_id", F.to_json(F.struct(F.transform("a", lambda e: F.coalesce(e["text"], F.lit(""))).alias("results"), F.transform("a", lambda e: F.coalesce(e["error"], F.lit(""))).alias("errors"))).alias("json"))


def pdf_json(pages: DataFrame, with_orientation: bool = True) -> DataFrame:
    """K5: a document's pages as one envelope, in order. ``pages`` has doc_id, page_index, dpi, width, height, results, mode, text_layer_quality,
    orientation_deg and, for pages with an image, image and image_content_type; fields that are null are left out."""
    image = [F.base64("image").alias("image_b64"), F.when(F.col("image").isNotNull(), F.col("image_content_type")).alias("image_content_type")]
    turned = [F.col("orientation_deg")] if with_orientation else []
    page = F.struct((F.col("page_index") + 1).alias("page"), "page_index", "dpi", "width", "height", F.coalesce("results", F.array().cast(pages.schema["results"].dataType)).alias("results"), "mode", "text_layer_quality", *turned, *image)
    rows = pages.select("doc_id", "page_index", F.to_json(page, {"ignoreNullFields": "true"}).alias("json"))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "json"))), lambda e: e["json"]), ",")
    return rows.groupBy("doc_id").agg(F.concat(F.lit('{"pages":['), inside, F.lit("]}")).alias("json"))


# Classes that Markdown for evaluation leaves out, and what it puts before the text of others.
UNREAD = ("footer", "footer_image", "header", "header_image", "image", "chart", "seal")
LEADS = {"doc_title": "# ", "paragraph_title": "## ", "figure_title": "### ", "abstract": "**Abstract** ", "aside_text": "> "}


def evaluation_markdown(results: DataFrame, layout: DataFrame, tables: DataFrame, formulas: DataFrame) -> DataFrame:
    """M7: Markdown for scores from the parts of pages: (page_id, markdown).

    ``results``: page_id, id, text, layout_id, box and place, null where a page has no reading order; ``layout``: page_id, id, label and box; ``tables`` and
    ``formulas``: page_id, layout_id and html or latex. A block's text is that of the lines that name it, else of those that name none and have their centre
    in it. Blocks go by the first line that names them, others after them from top to bottom.
    """
    middle = {"cx": F.col("x0") + F.col("x1"), "cy": F.col("y0") + F.col("y1")}
    lines = results.withColumns({**middle, "said": F.trim("text")}).select("page_id", F.col("id").alias("line"), "said", "layout_id", "place", "cx", "cy")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "line", "said"))), lambda e: e["said"]), " ")
    said = lines.where("said <> ''")
    named = said.groupBy("page_id", F.col("layout_id").alias("id")).agg(joined.alias("named"))
    free = said.where("layout_id is null or layout_id = -1")
    box = layout.select("page_id", "id", "x0", "y0", "x1", "y1")
    inside = F.col("cx").between(2 * F.col("x0"), 2 * F.col("x1")) & F.col("cy").between(2 * F.col("y0"), 2 * F.col("y1"))
    loose = free.join(box, "page_id").where(inside).groupBy("page_id", "id").agg(joined.alias("loose"))
    first = lines.groupBy("page_id", F.col("layout_id").alias("id")).agg(F.min("place").alias("first"))
    blocks = layout.join(named, ["page_id", "id"], "left").join(loose, ["page_id", "id"], "left").join(first, ["page_id", "id"], "left")
    blocks = blocks.join(tables.select("page_id", F.col("layout_id").alias("id"), F.trim("html").alias("html")), ["page_id", "id"], "left")
    blocks = blocks.join(formulas.select("page_id", F.col("layout_id").alias("id"), F.trim("latex").alias("latex")), ["page_id", "id"], "left").where(~F.col("label").isin(*UNREAD))
    text, label = F.coalesce("named", "loose", F.lit("")), F.col("label")
    formula = F.coalesce(F.nullif("latex", F.lit("")), F.nullif(text, F.lit("")), F.lit(" "))
    order = Window.partitionBy("page_id").orderBy(F.col("first").asc_nulls_last(), "y0", "x0", "id")
    cited = label.isin("reference", "reference_content")
    blocks = blocks.withColumns({"text": text, "cited": cited}).withColumn("heads", cited & (F.sum(cited.cast("int")).over(order) == 1))
    part = F.when(label == "table", F.coalesce(F.nullif("html", F.lit("")), F.lit("<table></table>"))).when(label == "display_formula", F.concat(F.lit("$$"), formula, F.lit("$$"))).when(label == "inline_formula", F.concat(F.lit("$"), formula, F.lit("$")))
    item = F.when(F.col("text") != "", F.concat(F.lit("- "), F.col("text")))
    part = part.when(F.col("heads"), F.concat_ws("\n\n", F.lit("### References"), item)).when(F.col("cited"), item).when(F.col("text") == "", None).when(label == "algorithm", F.concat(F.lit("```algorithm\n"), F.col("text"), F.lit("\n```"))).when(label == "content", item)
    lead = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LEADS.items() for x in pair)), label), F.lit(""))
    parts = blocks.select("page_id", F.row_number().over(order).alias("turn"), part.otherwise(F.concat(lead, F.col("text"))).alias("part")).where("part is not null")
    whole = parts.groupBy("page_id").agg(F.rtrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda e: e["part"]), "\n\n")).alias("md"))
    pages = layout.select("page_id").union(results.select("page_id")).distinct()
    return pages.join(whole, "page_id", "left").select("page_id", F.concat(F.coalesce("md", F.lit("")), F.lit("\n")).alias("markdown"))
