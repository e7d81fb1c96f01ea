"""Queries over detectors' boxes, columns, backends and dictionaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import backends, latex
from vellum.functions.recognizer import Digest
from vellum.operators import columns, detection
from vellum.plans.registry import query
from vellum.sources.views import sql, view


def corners():
    return [F.col(f"qx{k}") for k in (2, 0, 3, 1)], [F.col(f"qy{k}") for k in (2, 0, 3, 1)]


@query(sql("quads") + """, c as (select page_id, line_id, 0 as k, qx2 as x, qy2 as y from quads union all select page_id, line_id, 1, qx0, qy0 from quads union all select page_id, line_id, 2, qx3, qy3 from quads union all select page_id, line_id, 3, qx1, qy1 from quads),
r as (select page_id, line_id, list(x order by x, k) as xs, list(y order by x, k) as ys from c group by page_id, line_id), s as (select *, case when ys[1] < ys[2] then 1 else 2 end as tl, case when ys[3] < ys[4] then 3 else 4 end as tr from r)
select page_id, line_id, concat_ws(',', xs[tl], ys[tl], xs[tr], ys[tr], xs[7 - tr], ys[7 - tr], xs[3 - tl], ys[3 - tl]) as quad from s""")
def ordered_quads(spark, sf_dir):
    """P18"""
    quad = detection.ordered_quad(*corners())
    flat = F.transform(quad, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")))
    return view(spark, sf_dir, "quads").select("page_id", "line_id", F.array_join(flat, ",").alias("quad"))


@query(sql("quads") + """, d as (select page_id, line_id, sqrt((qx0 - qx1) * (qx0 - qx1) + (qy0 - qy1) * (qy0 - qy1)) as w, sqrt((qx0 - qx3) * (qx0 - qx3) + (qy0 - qy3) * (qy0 - qy3)) * (1 + line_id % 9 * 4) as h from quads) select page_id, line_id,
 greatest(1, least(3200, cast(ceil(case when w > 0 and h > 0 then w / (h / (1 + line_id % 9 * 4)) * 48 else 0 end) as int))) as crop from d""")
def crop_widths(spark, sf_dir):
    """Widths of crops"""
    xs, ys = [F.col(f"qx{k}") for k in range(4)], [F.col(f"qy{k}") for k in range(4)]
    return view(spark, sf_dir, "quads").select("page_id", "line_id", detection.crop_width(xs, ys, 48, 3200)[0].alias("crop"))


_FEATURES = "select page_id, cand_id, cast(cand_id % 5 as int) as points, x1 - x0 as width, (y1 - y0) % 12 as height, cast(score_milli % 9 as double) as side, score_milli / 1000.0 as score, cast(score_milli % 13 as double) as unclipped from {candidates}"


@query(sql("candidates") + ", f as (" + _FEATURES.format(candidates="candidates") + "), r as (select *, row_number() over (partition by page_id order by cand_id) as rk from f) select page_id, cand_id from r where rk <= 30 and points > 2 and width >= 3 and height >= 3 and side >= 3 and score >= 0.6 and unclipped >= 5")
def kept_candidates(spark, sf_dir):
    """F4, T3, T4"""
    return detection.keep_candidates(spark.sql(_FEATURES, candidates=view(spark, sf_dir, "candidates")), most=30).select("page_id", "cand_id")


@query(sql("lines", "regions") + """, t as (select * from regions where class_id = 21), h as (select t.page_id, t.region_id, min(l.x0) as hx0, min(l.y0) as hy0, max(l.x1) as hx1, max(l.y1) as hy1 from t join lines l on l.page_id = t.page_id and (l.x0 + l.x1) // 2 between t.x0 and t.x1 and (l.y0 + l.y1) // 2 between t.y0 and t.y1 group by t.page_id, t.region_id),
c as (select t.page_id, t.region_id, hx0 is not null and least(t.x1, hx1) > greatest(t.x0, hx0) and least(t.y1, hy1) > greatest(t.y0, hy0) as ok, t.x0, t.y0, t.x1, t.y1, greatest(t.x0, hx0) as a, greatest(t.y0, hy0) as b, least(t.x1, hx1) as c, least(t.y1, hy1) as d from t left join h using (page_id, region_id)),
e as (select page_id, region_id, case when ok then a else x0 end as x0, case when ok then b else y0 end as y0, case when ok then c else x1 end as x1, case when ok then d else y1 end as y1 from c)
select page_id, region_id, x0 - (x1 - x0) * 3 // 100 as x0, y0 - (y1 - y0) * 3 // 100 as y0, x1 + (x1 - x0) * 3 // 100 as x1, y1 + (y1 - y0) * 3 // 100 as y1 from e""")
def table_crops(spark, sf_dir):
    """P14"""
    return detection.table_crop(view(spark, sf_dir, "regions").where("class_id = 21"), view(spark, sf_dir, "lines"), snap=True)


@query("select p_partkey, case when p_size % 3 <> 0 then p_size * 300 end as width, case when p_size % 3 <> 0 then cast(p_partkey as int) end as height from part")
def png_sizes(spark, sf_dir):
    """S12"""
    four = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), four(F.col("p_size") * 300), four(F.col("p_partkey")))
    content = F.when(F.col("p_size") % 3 != 0, head).otherwise(F.lit(b"GIF89a"))
    width, height = detection.png_size(content)
    return view(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


@query("""with r as (select o_orderkey as id, case o_custkey % 3 when 0 then 'table' when 1 then 'formula' else 'text' end as modality, case o_orderkey % 4 when 0 then 'fast' when 1 then 'nope' else '' end as override_ from orders)
select id, case when override_ = 'fast' then 'fast' when override_ <> '' then 'ROUTING_UNKNOWN_OVERRIDE' when modality = 'table' then 'remote' end as backend from r""")
def backend_routes(spark, sf_dir):
    """S15, R8"""
    routing = backends.Routing.parse('{"backends": {"fast": {"kind": "local"}, "remote": {"kind": "openai", "url": "http://x", "parser": "otsl"}}, "routes": {"table": "remote", "formula": "default"}}')
    o = view(spark, sf_dir, "orders")
    modality = F.when(F.col("o_custkey") % 3 == 0, "table").when(F.col("o_custkey") % 3 == 1, "formula").otherwise("text")
    override = F.when(F.col("o_orderkey") % 4 == 0, "fast").when(F.col("o_orderkey") % 4 == 1, "nope").otherwise("")
    return o.select(F.col("o_orderkey").alias("id"), backends.resolved(routing, modality, override).alias("backend"))


@query("select p_partkey as page_id, count(*) as crops, count(*) filter (where p_size % 2 = 0 and p_brand <> '') as escalated from part group by p_partkey")
def model_cascade(spark, sf_dir):
    """Crops on pages with CJK text go to a second model"""
    crops = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("region_id"), F.col("p_brand").alias("content"), (F.col("p_size") % 2 == 0).alias("page_is_cjk"))
    return backends.cascade(crops, Digest, Digest).groupBy("page_id").agg(F.count("*").alias("crops"), F.count_if("escalated").alias("escalated"))


@query("select r_regionkey + 1 as idx, r_name as ch from region union all select 0, '' union all select count(*) + 1, ' ' from region")
def label_dictionary(spark, sf_dir):
    """S13"""
    lines = view(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("idx"), F.concat("r_name", F.lit("\r")).alias("value"))
    return backends.label_dictionary(lines)


@query("select cast(n_nationkey as bigint) as id, case when n_nationkey = 3 then '</s>' else n_name end as token, n_nationkey = 3 as special from nation")
def tokenizer_vocabulary(spark, sf_dir):
    """S14"""
    n = view(spark, sf_dir, "nation")
    vocab = F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("long"))))
    body = F.struct(F.struct(vocab.alias("vocab")).alias("model"), F.array(F.struct(F.lit(3).cast("long").alias("id"), F.lit("</s>").alias("content"), F.lit(True).alias("special"))).alias("added_tokens"))
    return backends.tokenizer_vocabulary(n.agg(F.to_json(body).alias("value")))


_PLACED = "select page_id, region_id, class_id, x0, y0, x1, y1, row_number() over (partition by page_id order by y0, x0, region_id) as place from {regions}"


@query(sql("regions") + ", placed as (" + _PLACED.format(regions="regions") + ") select * from (" + columns.COLUMN_MAJOR.format(ordered="placed") + ") q")
def column_major_order(spark, sf_dir):
    """Pages with columns are read column by column, others from top to bottom"""
    return columns.column_major(spark.sql(_PLACED, regions=view(spark, sf_dir, "regions")))


@query(r"""select doc_id, '\operatorname*{ab}x_{' || replace(regexp_extract(text, '^[^ \n]*'), '"', '') || '}漢字1+2\ y' as latex from documents""")
def latex_tidy(spark, sf_dir):
    """X32"""
    made = F.concat(F.lit("\\operatorname* {a b} x _ { "), F.regexp_extract("text", r"^[^ \n]*", 0), F.lit(" } \\text{漢字} \" 1 + 2 \\ y"))
    return latex.with_tidy(view(spark, sf_dir, "documents").select("doc_id", made.alias("latex")), "latex")
