"""Page-grain views derived from the test tables with integer arithmetic, the same in Spark and in DuckDB.

The tables have no boxes, layout or logits of their own, so these views make deterministic ones of orders and lines of orders. A template
has ``DIV`` for integer division and ``EACH2`` for two rows in place of one; :func:`view` runs it in Spark, and :func:`sql` gives its text for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TEMPLATES = {
    # 16 regions a page, two columns of eight.
    "regions": """
      select page_id, region_id, class_id, score_milli, x0, y0, x0 + w as x1, y0 + h as y1 from (
        select o_orderkey DIV 16 as page_id, cast(o_orderkey % 16 as int) as region_id, cast((o_custkey * 7 + o_orderkey) % 25 as int) as class_id,
          cast(250 + (o_custkey * 31 + o_orderkey * 17) % 750 as int) as score_milli,
          cast(40 + (o_orderkey % 2) * 480 + o_custkey % 17 as int) as x0, cast(40 + ((o_orderkey % 16) DIV 2) * 150 + o_custkey % 13 as int) as y0,
          cast(380 + o_custkey % 61 as int) as w, cast(90 + o_custkey % 47 as int) as h from {orders}) r""",
    # About 64 lines a page, some of them outside of all regions.
    "lines": """
      select page_id, line_id, text, conf_milli, x0, y0, x0 + w as x1, y0 + h as y1 from (
        select l_orderkey DIV 16 as page_id,
          row_number() over (partition by l_orderkey DIV 16 order by l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as line_id,
          concat(l_returnflag, l_linestatus, cast(l_partkey as varchar(20))) as text, cast(400 + (l_partkey * 13 + l_suppkey) % 600 as int) as conf_milli,
          cast(44 + (l_orderkey % 2) * 480 + l_partkey % 23 + case when l_partkey % 29 = 0 then 1000 else 0 end as int) as x0,
          cast(44 + ((l_orderkey % 16) DIV 2) * 150 + (l_linenumber - 1) * 16 + l_suppkey % 3 as int) as y0,
          cast(120 + l_partkey % 250 as int) as w, cast(10 + l_suppkey % 5 as int) as h from {lineitem}) l""",
    # Two overlapping detections of each region.
    "candidates": """
      select page_id, region_id * 2 + k as cand_id, class_id, score_milli - k * 37 as score_milli,
        x0 + k * (score_milli % 60) as x0, y0 + k * (score_milli % 20) as y0, x1 + k * (score_milli % 60) as x1, y1 + k * (score_milli % 20) as y1
      from (select *, EACH2 as k from {regions}) c""",
    # Quads: corners of the lines' boxes, tilted by a few pixels.
    "quads": """
      select page_id, line_id, x0 as qx0, y0 + line_id % 3 as qy0, x1 as qx1, y0 as qy1, x1 - line_id % 2 as qx2, y1 as qy2, x0 + line_id % 4 as qx3, y1 - line_id % 5 as qy3 from {lines}""",
    # A step for each eight components of a vector: scores of eight symbols.
    "requests": """
      select event_id, ts, event_type as route, case when value > 200 then 500 when value > 150 then 400 else 200 end as status, value / 100 as duration_s, cast(event_id % 1000 as bigint) as bytes from {events}""",
}
SPARK = {"DIV": "div", "EACH2": "explode(array(0, 1))", "EACH4": "explode(array(0, 1, 2, 3))"}
DUCKDB = {"DIV": "//", "EACH2": "unnest([0, 1])", "EACH4": "unnest([0, 1, 2, 3])"}
NEEDS = {k: re.findall(r"\{(\w+)\}", v) for k, v in TEMPLATES.items()}


def spoken(template: str, words: dict[str, str]) -> str:
    """The template in the SQL of one engine."""
    for token, own in words.items():
        template = template.replace(token, own)
    return template


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, or a view over it."""
    if name not in TEMPLATES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(spoken(TEMPLATES[name], SPARK), **{x: view(spark, sf_dir, x) for x in NEEDS[name]})


def sql(*names: str) -> str:
    """``with`` and the views that these views need, for DuckDB."""
    found: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            if x in TEMPLATES:
                add(x)
        text = f"{name} as ({spoken(TEMPLATES[name], DUCKDB).format(**{x: x for x in NEEDS[name]})})"
        if text not in found:
            found.append(text)

    for name in names:
        add(name)
    return "with " + ", ".join(found)
