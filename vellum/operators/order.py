"""Reading order by recursive cuts: the one family of operators that is sequential in each page, so it runs page by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import dims

#: Nesting of cuts, and places on an axis, beyond which boxes stay as they are.
DEPTH, PLACES = 64, 4096


def _islands(intervals: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Covered stretches of an axis that lie more than ``gap`` apart; intervals without length cover nothing."""
    furthest = max((b for _, b in intervals), default=0)
    scale = max(1, -(-furthest // PLACES))
    gap = max(1, gap // scale) if scale > 1 else gap
    cells = sorted((max(a, 0) // scale, -(-b // scale)) for a, b in intervals if max(a, 0) < b)
    out: list[list[int]] = []
    for a, b in cells:
        if out and a - (out[-1][1] - 1) <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a * scale, b * scale) for a, b in out]


def cut_order(boxes: list[tuple[int, int, int, int]], gap: int = 1) -> list[int]:
    """Numbers of the boxes in reading order. Columns are cut first, then rows in each, and each row again, until nothing parts."""
    out: list[int] = []

    def go(own: list[int], depth: int) -> None:
        if len(own) <= 1 or depth >= DEPTH:
            out.extend(own)
            return
        across = sorted(own, key=lambda i: boxes[i][0])
        columns = _islands([(boxes[i][0], boxes[i][2]) for i in across], 1)
        if not columns:
            out.extend(across)
            return
        for left, right in columns:
            down = sorted((i for i in across if left <= abs(boxes[i][0]) < right), key=lambda i: boxes[i][1])
            rows = _islands([(boxes[i][1], boxes[i][3]) for i in down], gap)
            if len(rows) <= 1:
                out.extend(down)
                continue
            for top, bottom in rows:
                inner = [i for i in down if top <= boxes[i][1] < bottom]
                if len(inner) == len(down):
                    out.extend(inner)
                elif inner:
                    go(inner, depth + 1)

    go(list(range(len(boxes))), 0)
    missed = set(range(len(boxes))) - set(out)
    return out + sorted(missed)


def by_page(rows: DataFrame, fields: list[str], work: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``work`` for each page, behind its page_id. A page is one array, sorted by ``fields``, so Arrow batches hold many pages and a page costs no call of its own."""
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    width = len(schema.split(","))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in range(width + 1)]
            for page, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in work(own):
                    for column, value in zip(out, (page, *row)):
                        column.append(value)
            names = ["page_id", *(x.split()[0] for x in schema.split(","))]
            kinds = [pa.int64(), *({"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in schema.split(","))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return pages.mapInArrow(run, f"page_id long, {schema}")


def _box(row: dict) -> tuple[int, int, int, int]:
    return row["x0"], row["y0"], row["x1"], row["y1"]


def _bucketed(page: list[dict], gap: int) -> list[int]:
    """Places in ``page`` in reading order: headers, body, footers, each by its own cuts."""
    out = []
    for bucket in range(3):
        own = [i for i, r in enumerate(page) if dims.bucket_of(r["class_id"]) == bucket]
        out += [own[k] for k in cut_order([_box(page[i]) for i in own], gap)]
    return out


def region_order(regions: DataFrame, gap: int = 1) -> DataFrame:
    """Place of each region on its page: headers, body, footers, each by its own cuts."""
    fields = ["region_id", "class_id", "x0", "y0", "x1", "y1"]
    return by_page(regions, fields, lambda page: [(page[i]["region_id"], k + 1) for k, i in enumerate(_bucketed(page, gap))], "region_id int, position int")


def line_order(ordered_lines: DataFrame, regions: DataFrame, gap: int = 1) -> DataFrame:
    """U1, U6, G6 without insertion: lines by their region's place and their own in it; orphans take part in the cuts of the body as boxes of their own.

    ``ordered_lines`` has region_id, null for orphans, and position, the place in its region.
    """
    boxes = regions.select("page_id", F.lit(0).alias("kind"), F.col("region_id").cast("long").alias("id"), "class_id", "x0", "y0", "x1", "y1")
    orphans = ordered_lines.where("region_id is null").select("page_id", F.lit(1).alias("kind"), F.col("line_id").cast("long").alias("id"), F.lit(22).alias("class_id"), "x0", "y0", "x1", "y1")
    fields = ["kind", "id", "class_id", "x0", "y0", "x1", "y1"]
    slots = by_page(boxes.unionByName(orphans), fields, lambda page: [(page[i]["kind"], page[i]["id"], k + 1) for k, i in enumerate(_bucketed(page, gap))], "kind int, id long, slot int")
    placed = ordered_lines.select("page_id", "line_id", "position", F.when(F.col("region_id").isNull(), 1).otherwise(0).alias("kind"), F.coalesce(F.col("region_id"), F.col("line_id")).cast("long").alias("id"))
    by = Window.partitionBy("page_id").orderBy("slot", "position", "line_id")
    return placed.join(slots, ["page_id", "kind", "id"]).select("page_id", "line_id", F.row_number().over(by).alias("place"))


def descendants(links: dict[int, list[int]], boxes: list[tuple[int, int]], root: int) -> list[int]:
    """All below a region, parents before children, children by (y, x); a region met before is left out, so cycles end."""
    seen, out = {root}, []

    def go(parent: int) -> None:
        for child in sorted(links.get(parent, ()), key=lambda i: (boxes[i], i)):
            if child not in seen:
                seen.add(child)
                out.append(child)
                go(child)

    go(root)
    return out
