"""Documents from pages: levels of headings, merged tables, and text that repeats itself."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as t


def title_height(content: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Height of a line of a title: of the box's shorter side, by its shape."""
    w, h = x1 - x0, F.greatest(F.lit(1), y1 - y0)
    lines = F.size(F.split(t.trim(content), "\n"))
    return F.floor(F.when(w >= h, h).otherwise(w) / lines).cast("int")


def height_levels(heights: list[int], most: int = 4, rounds: int = 100) -> dict[int, int]:
    """Level of each height by one-dimensional k-means: 1 is the highest. Centres start at even places of the different heights."""
    different = sorted(set(heights))
    k = min(most, len(different))
    if not k:
        return {}
    centres = [float(different[0])] if k == 1 else [float(different[int(j * (len(different) - 1) / (k - 1) + 0.5)]) for j in range(k)]
    nearest = lambda h: min(range(k), key=lambda j: (abs(h - centres[j]), j))
    for _ in range(rounds):
        own: list[list[int]] = [[] for _ in range(k)]
        for h in heights:
            own[nearest(h)].append(h)
        moved = [sum(x) / len(x) if x else c for x, c in zip(own, centres)]
        still = all(abs(a - b) <= 1e-9 for a, b in zip(moved, centres))
        centres = moved
        if still:
            break
    rank = {j: i + 1 for i, j in enumerate(sorted(range(k), key=lambda j: -centres[j]))}
    return {h: rank[nearest(h)] for h in different}


def with_height_levels(titles: DataFrame) -> DataFrame:
    """A19 for the titles (doc_id, pos, height) of each document."""

    def run(frame):
        levels = height_levels([int(h) for h in frame["height"]])
        return frame.assign(cluster=[levels[int(h)] for h in frame["height"]])[["doc_id", "pos", "cluster"]]

    return titles.join(titles.select("doc_id", "pos", "height").groupBy("doc_id").applyInPandas(run, "doc_id long, pos long, cluster int"), ["doc_id", "pos"])


def title_levels(titles: DataFrame) -> DataFrame:
    """Level of each title (doc_id, pos, content, cluster), 1 to 6.

    Numbered titles take the majority of the level of their number, the rank in which their kind of number came up and the height's level, or the rank where all three differ;
    dotted numbers shift their rank by the depth beyond the first dotted title's. Keywords are at level 1; others take the height's level.
    """
    kind, level = t.numbering(F.col("content"))
    marked = titles.withColumns({"kind": kind, "own": level})
    by = Window.partitionBy("doc_id").orderBy("pos")
    first = marked.where("kind is not null").groupBy("doc_id", "kind").agg(F.min("pos").alias("first_pos"))
    ranks = first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos")))
    joined = marked.join(ranks, ["doc_id", "kind"], "left")
    dotted = F.first(F.when(F.col("kind") == "NUM_LIST", F.col("own")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    relative = F.when(F.col("kind") == "NUM_LIST", F.col("rank") + F.col("own") - dotted).otherwise(F.col("rank"))
    own, cluster = F.col("own"), F.col("cluster")
    vote = F.when((own == relative) | (own == cluster), own).when(relative == cluster, relative).otherwise(relative)
    final = F.when(F.col("kind").isNotNull(), vote).when(t.is_keyword(F.col("content")), 1).otherwise(cluster)
    return joined.select("doc_id", "pos", F.greatest(F.lit(1), F.least(F.lit(6), final)).cast("int").alias("level"))


def merge_tables(blocks: DataFrame) -> DataFrame:
    """Tables that go on across pages, joined: (doc_id, page_index, pos, group, html).

    ``blocks`` has doc_id, page_index, pos, label and content. A page's first table goes on from the last table of the page before if nothing but furniture stands between and
    both have as many columns. Rows are appended to the first page's table; a repeated header row is left out. Pages are worked on from the last to the first, one document at a time.
    """
    from vellum.operators.tables import grid_width

    furniture = ("header", "footer", "header_image", "footer_image", "number", "footnote")
    row_of = re.compile(r"(?is)<tr.*?</tr>")
    cell_of = re.compile(r"(?is)<t[dh]([^>]*)>(.*?)</t[dh]>")

    def span(tag: str, name: str) -> int:
        found = re.search(rf"{name}\s*=\s*[\"']?(\d+)", tag)
        return max(1, min(512, int(found[1]))) if found else 1

    def parse(html: str):
        rows = row_of.findall(html)
        cells = [[(span(a, "colspan"), span(a, "rowspan"), re.sub(r"\s+", "", re.sub(r"<[^>]*>?", "", x))) for a, x in cell_of.findall(r)] for r in rows]
        return rows, cells

    def run(frame):
        frame = frame.sort_values(["page_index", "pos"]).reset_index(drop=True)
        html, group = frame["content"].tolist(), list(range(len(frame)))
        pages: dict[int, list[int]] = {}
        for i, p in enumerate(frame["page_index"]):
            pages.setdefault(int(p), []).append(i)
        skip = lambda i: frame["label"][i] in furniture or re.search(r"continued?|cont'd|续", (html[i] or "").lower())
        for page in sorted(pages, reverse=True):
            real = lambda q: [i for i in pages.get(q, ()) if frame["label"][i] == "table" or not skip(i)]
            before, here = real(page - 1), real(page)
            if not before or not here or frame["label"][before[-1]] != "table" or frame["label"][here[0]] != "table":
                continue
            host, guest = before[-1], here[0]
            host_rows, host_cells = parse(html[host] or "")
            rows, cells = parse(html[guest] or "")
            width = lambda c: grid_width([[x[:2] for x in r] for r in c])
            if not rows or not host_rows or width(cells) != width(host_cells):
                continue
            same = [x[2] for x in cells[0]] == [x[2] for x in host_cells[0]]
            tail = "".join(rows[int(same) :])
            at = html[host].lower().rfind("</table>")
            html[host] = html[host][:at] + tail + html[host][at:] if at >= 0 else html[host] + tail
            html[guest] = ""
            group = [host if x == guest else x for x in group]
        return frame.assign(html=html, group=group)[["doc_id", "page_index", "pos", "label", "group", "html"]]

    return blocks.select("doc_id", "page_index", "pos", "label", "content").groupBy("doc_id").applyInPandas(run, "doc_id long, page_index long, pos long, label string, group int, html string")


def repeating_unit(text: str) -> str | None:
    """The shortest text of which the whole is two or more copies."""
    at = (text + text).find(text, 1)
    return text[:at] if 0 < at < len(text) else None


def repeating_suffix(text: str, shortest: int = 8, least: int = 5) -> tuple[str, str, int] | None:
    """(what stands before, unit, copies) of the text's tail, for the shortest unit of which ``least`` copies end the text."""
    for size in range(shortest, len(text) // least + 1):
        unit = text[-size:]
        n = 1
        while text[-size * (n + 1) : len(text) - size * n] == unit:
            n += 1
        if n >= least:
            return text[: len(text) - size * n], unit, n
    return None


def truncate_repetition(content: str, min_count: int = 3000, lines: int = 10, copies: int = 10) -> str:
    """The text without what a decoder that lost its way repeats: a phrase at the end, a unit of the whole, or one line over and over. Lengths are bytes."""
    raw = content.encode()
    clean = raw.strip(b" \t\n\x0b\f\r")
    if len(raw) < min_count or not clean:
        return content
    if b"\n" not in clean and len(clean) <= 65536:
        one = clean.decode("latin-1")
        if len(clean) > 100 and (tail := repeating_suffix(one)) and len(tail[1]) * tail[2] > len(clean) * 0.5:
            return tail[0].encode("latin-1").decode("utf-8", "replace")
        if (unit := repeating_unit(one)) and len(one) // len(unit) >= copies:
            return unit.encode("latin-1").decode("utf-8", "replace")
    own = [x for x in (y.strip(" \t\n\x0b\f\r") for y in content.split("\n")) if x]
    best, counts = "", {}
    for x in own:
        counts[x] = counts.get(x, 0) + 1
        if counts[x] > counts.get(best, 0) or not best:
            best = x
    return best if len(own) >= lines and counts[best] >= lines and counts[best] >= 0.8 * len(own) else content


def without_repetition(frame: DataFrame, column: str, min_count: int = 3000) -> DataFrame:
    """G19 for a column of texts, in Arrow batches."""
    def cut(texts):
        return texts.map(lambda x: None if x is None else truncate_repetition(x, min_count))

    cut.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    cut = F.pandas_udf(cut, "string")
    return frame.withColumn(column, cut(column))
