"""Queries over regions and lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import dims, geometry as g
from vellum.operators import layout, lines as ln
from vellum.plans.registry import query
from vellum.sources.views import sql, view

INSIDE = "l.x0 + l.x1 >= 2 * r.x0 and l.x0 + l.x1 <= 2 * r.x1 and l.y0 + l.y1 >= 2 * r.y0 and l.y0 + l.y1 <= 2 * r.y1"
OWNER = f"owner as (select l.page_id, l.line_id, min(r.region_id) as region_id from lines l left join regions r on l.page_id = r.page_id and {INSIDE} group by l.page_id, l.line_id)"
BASE = sql("lines", "regions") + ", " + OWNER
OWNED = "owned as (select l.*, o.region_id from lines l join owner o using (page_id, line_id) where o.region_id is not null)"


def both(spark, sf_dir):
    return view(spark, sf_dir, "lines"), view(spark, sf_dir, "regions")


def owned_lines(spark, sf_dir):
    lines, regions = both(spark, sf_dir)
    return layout.with_owner(lines, regions).where("region_id is not null")


@query(BASE + " select * from owner")
def assign_regions(spark, sf_dir):
    """J1"""
    return layout.assign_regions(*both(spark, sf_dir))


@query(BASE + """, hull as (select page_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from lines join owner using (page_id, line_id) where region_id is null group by page_id)
select page_id, region_id, class_id, score_milli, x0, y0, x1, y1 from regions
union all select h.page_id, cast(n as int), -1, 1000, h.x0, h.y0, h.x1, h.y1 from hull h join (select page_id, count(*) as n from regions group by page_id) c using (page_id)""")
def supplementary_regions(spark, sf_dir):
    """J2, A9, U2"""
    return layout.supplementary_regions(*both(spark, sf_dir))


@query(sql("lines") + " select * from lines where conf_milli >= 500 and text <> ''")
def confident_lines(spark, sf_dir):
    """F1"""
    return layout.keep_confident(view(spark, sf_dir, "lines"))


@query(sql("candidates") + """, cut as (select page_id, cand_id, class_id, score_milli, greatest(0, least(x0, 900)) as x0, greatest(0, least(y0, 1200)) as y0, greatest(0, least(x1, 900)) as x1, greatest(0, least(y1, 1200)) as y1
from candidates where score_milli >= 300 and class_id between 0 and 24) select * from cut where x1 > x0 and y1 > y0""")
def layout_decode(spark, sf_dir):
    """F2"""
    return layout.decode_filter(view(spark, sf_dir, "candidates"), 900, 1200)


@query(sql("regions") + ", grown as (select page_id, region_id, class_id, score_milli, x0, y0, x1 + (region_id % 3) * 700 as x1, y1 + (region_id % 3) * 700 as y1 from regions) select * from grown where not (class_id = 14 and cast(x1 - x0 as bigint) * (y1 - y0) * 100 > 82 * 1200 * 1300)")
def oversized_images(spark, sf_dir):
    """F3"""
    grown = view(spark, sf_dir, "regions").withColumns({k: F.col(k) + (F.col("region_id") % 3) * 700 for k in ("x1", "y1")})
    return layout.drop_oversized_images(grown, 1200, 1300)


_KILL = """greatest(0, least(k.x1, c.x1) - greatest(k.x0, c.x0) + 1) * greatest(0, least(k.y1, c.y1) - greatest(k.y0, c.y0) + 1) * 100 >=
 ((k.x1 - k.x0 + 1) * (k.y1 - k.y0 + 1) + (c.x1 - c.x0 + 1) * (c.y1 - c.y0 + 1) - greatest(0, least(k.x1, c.x1) - greatest(k.x0, c.x0) + 1) * greatest(0, least(k.y1, c.y1) - greatest(k.y0, c.y0) + 1))
 * case when k.class_id = c.class_id then 60 else 98 end"""


@query(sql("candidates").replace("with ", "with recursive ", 1) + f""", ranked as (select *, row_number() over (partition by page_id order by score_milli desc, cand_id) as rk from candidates),
it(page_id, rk, kept) as (
  select page_id, cast(0 as bigint), cast([] as struct(cand_id bigint, class_id int, x0 bigint, y0 bigint, x1 bigint, y1 bigint)[]) from (select distinct page_id from candidates) p
  union all
  select it.page_id, c.rk, case when len(list_filter(it.kept, lambda k : {_KILL})) > 0 then it.kept
    else list_append(it.kept, struct_pack(cand_id := cast(c.cand_id as bigint), class_id := c.class_id, x0 := cast(c.x0 as bigint), y0 := cast(c.y0 as bigint), x1 := cast(c.x1 as bigint), y1 := cast(c.y1 as bigint))) end
  from it join ranked c on c.page_id = it.page_id and c.rk = it.rk + 1)
select page_id, cast(unnest(kept).cand_id as int) as cand_id from (select page_id, arg_max(kept, rk) as kept from it group by page_id) f""")
def suppression(spark, sf_dir):
    """J4, P8, T2"""
    return layout.suppress(view(spark, sf_dir, "candidates"))


_PAIRS = """, pairs as (select a.page_id, a.cand_id as a_id, b.cand_id as b_id from candidates a join candidates b on a.page_id = b.page_id and a.cand_id <> b.cand_id and (a.class_id in (5, 15)) = (b.class_id in (5, 15))
 and greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) * 100 >= (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) * 90)"""


@query(sql("candidates") + _PAIRS + """ select c.page_id, c.cand_id, c.class_id, cast(exists (select 1 from pairs p where p.page_id = c.page_id and p.a_id = c.cand_id) as int) as inside,
 cast(exists (select 1 from pairs p where p.page_id = c.page_id and p.b_id = c.cand_id) as int) as holds from candidates c""")
def nesting_flags(spark, sf_dir):
    """J5"""
    return layout.nesting(view(spark, sf_dir, "candidates"), "cand_id").select("page_id", "cand_id", "class_id", "inside", "holds")


@query(sql("candidates") + _PAIRS + " select c.page_id, c.cand_id from candidates c where not exists (select 1 from pairs p where p.page_id = c.page_id and p.a_id = c.cand_id)")
def nested_outer(spark, sf_dir):
    """Keeps the outer regions"""
    return layout.reconcile_nested(view(spark, sf_dir, "candidates"), "outer", "cand_id").select("page_id", "cand_id")


_STATS = BASE + ", " + OWNED + """, sums as (select page_id, region_id, count(*) as n, sum(cast(x1 - x0 as bigint) * (y1 - y0)) as covered, sum(case when x1 > x0 and y1 > y0 then (x1 - x0) * 1000 // (y1 - y0) else 0 end) as shapes from owned group by page_id, region_id),
stats as (select r.*, coalesce(n, 0) as n_lines, cast(case when (x1 - x0) * (y1 - y0) > 0 then least(1000, coalesce(covered, 0) * 1000 // (cast(x1 - x0 as bigint) * (y1 - y0))) else 0 end as bigint) as coverage_milli,
 cast(case when coalesce(n, 0) > 0 then shapes // n else 0 end as bigint) as shape_milli, least(1.0, coalesce(n, 0) / ln(1 + greatest(1, cast(x1 - x0 as bigint) * (y1 - y0)))) as symbol_density
 from regions r left join sums using (page_id, region_id))"""


@query(_STATS + " select * from stats")
def region_statistics(spark, sf_dir):
    """J3, A1, P26"""
    return layout.region_statistics(*both(spark, sf_dir))


_SHIFTED = sql("regions").replace("regions as (", "base as (", 1) + ", regions as (select page_id, region_id, class_id, score_milli, x0, y0, x1 + (class_id % 4) * 90 as x1, y1 + (score_milli % 5) * 60 as y1 from base)"
_TIES = f""", ra as (select r.*, c.priority, c.destination, c.trust_milli, c.verify_milli, cast(x1 - x0 as bigint) * (y1 - y0) as area from regions r join classes c using (class_id)),
p0 as (select a.page_id, a.region_id as i, b.region_id as j, a.class_id as ci, b.class_id as cj, a.area as aa, b.area as ab, a.priority as pi, b.priority as pj, a.score_milli as si, b.score_milli as sj,
  cast(least(a.x1, b.x1) - greatest(a.x0, b.x0) as bigint) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as s
  from ra a join ra b on a.page_id = b.page_id and a.region_id < b.region_id and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)),
p1 as (select *, (s * 100 >= ab * 80 and aa > ab) as oa, (s * 100 >= aa * 80 and ab > aa) as ob, (s * 100 >= (aa + ab - s) * 30 and s * 100 <= (aa + ab - s) * 80) as mid,
  case when pi <> pj then pi > pj when abs(si - sj) > 10 then si > sj when aa <> ab then aa > ab else true end as j_loses from p0),
p2 as (select page_id, i, j, case when oa then case when ci <> 21 then i end when ob then case when cj <> 21 then j end when mid then case when j_loses then j else i end end as region_id,
  case when oa or ob then 'containment' else 'overlap' end as reason from p1),
ties as (select page_id, region_id, reason from (select *, row_number() over (partition by page_id, region_id order by i, j) as rn from p2 where region_id is not null) t where rn = 1)"""


def shifted(spark, sf_dir):
    return view(spark, sf_dir, "regions").withColumns({"x1": F.col("x1") + (F.col("class_id") % 4) * 90, "y1": F.col("y1") + (F.col("score_milli") % 5) * 60})


@query(_SHIFTED + ", " + dims.CLASSES_SQL + _TIES + " select * from ties")
def tie_breaks(spark, sf_dir):
    """J6, P9, P23"""
    return layout.tie_breaks(shifted(spark, sf_dir))


_ROUTE = (
    sql("lines").replace("lines as (", "lines as (", 1) + ", " + _SHIFTED.removeprefix("with ") + ", " + OWNER + ", " + OWNED + _STATS.split(OWNED)[1] + ", " + dims.CLASSES_SQL + _TIES
    + """, w as (select s.*, c.destination, max(cast(class_id in (3, 5, 14, 15, 21) as int)) over (partition by page_id) = 1 as gate, max(cast(class_id in (5, 15) and score_milli >= trust_milli as int)) over (partition by page_id) = 1 as formulas,
  case when score_milli >= trust_milli then 'trust' when score_milli >= verify_milli then 'verify' else 'fallback' end as tier from stats s join classes c using (class_id)),
x as (select *, gate and ((class_id = 3 and n_lines >= 2) or (class_id = 14 and n_lines >= 3 and coverage_milli >= 150)) as passed from w),
y as (select *, case when passed then 'text' else destination end as d1 from x),
z as (select *, case when tier = 'fallback' then 'text' else d1 end as d2, case when tier = 'fallback' and d1 = 'formula' then 'none' when class_id = 5 then 'display' when class_id = 15 then 'inline' else 'none' end as w2,
  case when tier = 'fallback' and d1 = 'table' then 'table_fallback' when tier = 'fallback' and d1 = 'formula' then 'formula_fallback' when tier = 'fallback' and d1 = 'skip' then 'passthrough' when passed then 'passthrough' when class_id = -1 then 'supplementary' else 'class_default' end as r2 from y),
v as (select *, formulas and gate and d2 = 'text' and class_id = 22 and n_lines <= 3 and (shape_milli >= 6000 or (shape_milli > 0 and shape_milli * 6 <= 1000)) and symbol_density > 0.4 as also_text from z),
u as (select page_id, region_id, tier, case when also_text then 'formula' else d2 end as d3, case when also_text then 'inline' else w2 end as w3, case when also_text then 'formula_salvage' else r2 end as r3, also_text from v),
plan as (select u.page_id, u.region_id, tier, case when t.reason is not null and d3 <> 'text' then 'text' else d3 end as dest, case when t.reason is not null and d3 <> 'text' then 'none' else w3 end as wrap,
  case when t.reason is not null and d3 <> 'text' then t.reason || '_loser' else r3 end as reason, also_text from u left join ties t on t.page_id = u.page_id and t.region_id = u.region_id)"""
)


@query(_ROUTE + " select * from plan")
def route_regions(spark, sf_dir):
    """R1, R2, R3, A2, A3, P19-P25"""
    return layout.route(view(spark, sf_dir, "lines"), shifted(spark, sf_dir))


@query(_ROUTE + " select o.page_id, o.line_id, o.region_id, coalesce(p.dest in ('table', 'formula') and not p.also_text, false) as suppressed from owner o left join plan p on p.page_id = o.page_id and p.region_id = o.region_id")
def suppressed_lines(spark, sf_dir):
    """Lines that tables and formulas own"""
    return layout.suppressed_lines(view(spark, sf_dir, "lines"), shifted(spark, sf_dir))


@query("with " + dims.CLASSES_SQL + " select * from classes")
def class_dimension(spark, sf_dir):
    """P19, P20, P22, P23, D5"""
    return dims.layout_classes(spark)


@query("with " + dims.ERRORS_SQL + " select http_status, grpc_status, count(*) as codes from errors group by http_status, grpc_status")
def error_dimension(spark, sf_dir):
    """P34, D21"""
    return dims.error_codes(spark).groupBy("http_status", "grpc_status").agg(F.count("*").alias("codes"))


@query(sql("quads") + """ select page_id, line_id, least(qx0, qx1, qx2, qx3) as x0, least(qy0, qy1, qy2, qy3) as y0, greatest(qx0, qx1, qx2, qx3) as x1, greatest(qy0, qy1, qy2, qy3) as y1,
 (qx0 + qx1 + qx2 + qx3) / 4.0 as cx, (qy0 + qy1 + qy2 + qy3) / 4.0 as cy from quads""")
def quad_boxes(spark, sf_dir):
    """P1, P4, P6"""
    q = view(spark, sf_dir, "quads")
    xs, ys = ([F.col(f"q{a}{k}") for k in range(4)] for a in "xy")
    return q.select("page_id", "line_id", *(c.alias(n) for c, n in zip(g.aabb(xs, ys), ("x0", "y0", "x1", "y1"))), (sum(xs[1:], xs[0]) / 4.0).alias("cx"), (sum(ys[1:], ys[0]) / 4.0).alias("cy"))


@query(sql("lines") + """, t as (select page_id, line_id, x0, y0, case when line_id % 7 = 0 then x0 + 8 else x1 end as x1, y1 from lines)
select page_id, line_id, (cast(y1 - y0 as bigint) * (y1 - y0)) >= (cast(x1 - x0 as bigint) * (x1 - x0) * 225) // 100 as vertical, cast(x1 - x0 as bigint) * (y1 - y0) as area,
 greatest(0, least(x0, 799)) as crop_x, greatest(0, least(y0, 999)) as crop_y, greatest(1, least(x1, 800) - greatest(0, least(x0, 799))) as crop_w, greatest(1, least(y1, 1000) - greatest(0, least(y0, 999))) as crop_h,
 cast(round(x0 * 150 / 72.0) as int) as pixels, least(x1 - x0, y1 - y0) as short_side, greatest(x1 - x0, y1 - y0) as long_side,
 case when x1 - x0 <= 160 then 160 when x1 - x0 <= 240 then 240 when x1 - x0 <= 320 then 320 else 480 end as bucket, greatest(32, cast(round((x1 - x0) * 2 / 32.0) * 32 as int)) as side from t""")
def box_projections(spark, sf_dir):
    """P2, P3, P7, P13, P16, P17"""
    t = view(spark, sf_dir, "lines").withColumn("x1", F.when(F.col("line_id") % 7 == 0, F.col("x0") + 8).otherwise(F.col("x1")))
    b = g.box()
    crop = g.clamped_crop(b, 800, 1000)
    w, h = b[2] - b[0], b[3] - b[1]
    return t.select(
        "page_id", "line_id", g.is_vertical(b).alias("vertical"), g.area(b).alias("area"), *(c.alias(f"crop_{n}") for c, n in zip(crop, "xywh")), g.points_to_pixels(b[0], 150).alias("pixels"),
        F.least(w, h).alias("short_side"), F.greatest(w, h).alias("long_side"), g.snap(w, (160, 240, 320, 480)).alias("bucket"), g.detector_side(w, F.lit(2)).alias("side"),
    )


@query(sql("regions") + """ select a.page_id, a.region_id as a, b.region_id as b, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as shared_y, least(a.y1 - a.y0, b.y1 - b.y0) as short_y,
 cast(greatest(0, a.x0 - b.x1, b.x0 - a.x1) as bigint) * greatest(0, a.x0 - b.x1, b.x0 - a.x1) + cast(greatest(0, a.y0 - b.y1, b.y0 - a.y1) as bigint) * greatest(0, a.y0 - b.y1, b.y0 - a.y1) as distance,
 abs(a.x0 - b.x0) + abs(a.y0 - b.y0) as manhattan from regions a join regions b on a.page_id = b.page_id and a.region_id < b.region_id""")
def pair_distances(spark, sf_dir):
    """P10, P11, P12"""
    r = view(spark, sf_dir, "regions")
    a, b = r.alias("a"), r.alias("b")
    ba, bb = ([F.col(f"{x}.{k}") for k in ("x0", "y0", "x1", "y1")] for x in "ab")
    shared, short = g.overlap_small(ba[1], ba[3], bb[1], bb[3])
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.region_id") < F.col("b.region_id")))
    return pairs.select(F.col("a.page_id").alias("page_id"), F.col("a.region_id").alias("a"), F.col("b.region_id").alias("b"), shared.alias("shared_y"), short.alias("short_y"), g.edge_distance(ba, bb).alias("distance"), g.manhattan(ba, bb).alias("manhattan"))


@query(sql("lines") + " select page_id, line_id, row_number() over (partition by page_id order by y0 // 10, x0, line_id) as position from lines")
def band_order(spark, sf_dir):
    """W1, T1"""
    return ln.band_order(view(spark, sf_dir, "lines")).select("page_id", "line_id", "position")


@query(sql("lines") + " select page_id, line_id, row_number() over (partition by page_id order by y0 + y1, x0 + x1, line_id) as position from lines")
def page_order(spark, sf_dir):
    """W3"""
    return ln.page_order(view(spark, sf_dir, "lines")).select("page_id", "line_id", "position")


_TOLERANCE = """, tol as (select page_id, region_id, case when count(*) < 2 then 8 else greatest(4, list_sort(list(greatest(1, y1 - y0)))[len(list(y0)) // 2 + 1] // 3) end as tolerance from owned group by page_id, region_id)"""
_ROWS = ", rows_ as (select o.*, row_number() over (partition by page_id, region_id order by ((y0 + y1) // 2) // tolerance, x0 + x1, line_id) as position from owned o join tol using (page_id, region_id))"


@query(BASE + ", " + OWNED + _TOLERANCE + _ROWS + " select page_id, line_id, region_id, position from rows_")
def row_order(spark, sf_dir):
    """W2, A7"""
    return ln.row_order(owned_lines(spark, sf_dir)).select("page_id", "line_id", "region_id", "position")


@query(BASE + ", " + OWNED + " select page_id, region_id, count(*) as n, count(*) filter (where 3 * (x1 - x0) >= 2 * (y1 - y0)) as horizontal, count(*) filter (where 3 * (x1 - x0) >= 2 * (y1 - y0)) * 2 >= count(*) as is_horizontal from owned group by page_id, region_id")
def direction_vote(spark, sf_dir):
    """A4"""
    return ln.direction_vote(owned_lines(spark, sf_dir))


@query(BASE + " select page_id, count(*) as n, count(region_id) as matched, count(region_id) >= greatest(1, (count(*) * 5 + 99) // 100) as enough from owner group by page_id")
def matched_pages(spark, sf_dir):
    """A8"""
    lines, regions = both(spark, sf_dir)
    return ln.matched_pages(lines, layout.assign_regions(lines, regions))


_CLUSTER = """, o as (select *, row_number() over (partition by page_id, region_id order by y0, line_id, x0, x1, y1) as rk from owned),
it(page_id, region_id, rk, x0, y0, x1, y1, row_) as (
  select page_id, region_id, rk, x0, y0, x1, y1, cast(1 as bigint) from o where rk = 1
  union all
  select n.page_id, n.region_id, n.rk, case when j then least(i.x0, n.x0) else n.x0 end, case when j then least(i.y0, n.y0) else n.y0 end, case when j then greatest(i.x1, n.x1) else n.x1 end, case when j then greatest(i.y1, n.y1) else n.y1 end, i.row_ + case when j then 0 else 1 end
  from (select i.*, n.rk as nrk, (least(i.y1 - i.y0, n.y1 - n.y0) > 0 and greatest(0, least(i.y1, n.y1) - greatest(i.y0, n.y0)) * 100 >= least(i.y1 - i.y0, n.y1 - n.y0) * 60) as j from it i join o n on n.page_id = i.page_id and n.region_id = i.region_id and n.rk = i.rk + 1) i
  join o n on n.page_id = i.page_id and n.region_id = i.region_id and n.rk = i.nrk),
closed as (select page_id, region_id, row_, arg_max(x0, rk) as x0, arg_max(y0, rk) as y0, arg_max(x1, rk) as x1, arg_max(y1, rk) as y1 from it group by page_id, region_id, row_),
clusters as (select page_id, region_id, cast(count(*) as int) as n_rows, cast(sum(y1 - y0) // count(*) as bigint) as row_height, cast(sum(x1 - x0) // count(*) as bigint) as row_width, arg_min(x0, row_) as starts_at, arg_max(x1, row_) as ends_at from closed group by page_id, region_id)"""
_RECURSIVE = BASE.replace("with ", "with recursive ", 1) + ", " + OWNED + _CLUSTER


@query(_RECURSIVE + " select * from clusters")
def cluster_rows(spark, sf_dir):
    """G1, A5"""
    return ln.cluster_rows(owned_lines(spark, sf_dir))


@query(_RECURSIVE + " select page_id, cast(sum(row_width) // count(*) as bigint) as row_width, cast(sum(row_height) // count(*) as bigint) as row_height from clusters join regions using (page_id, region_id) where class_id = 22 and row_height > 0 group by page_id")
def page_row_size(spark, sf_dir):
    """A6"""
    return ln.page_row_size(ln.cluster_rows(owned_lines(spark, sf_dir)), view(spark, sf_dir, "regions"))


@query(sql("regions") + """, e as (select page_id, place, sum(change) as change from (select page_id, x0 as place, 1 as change from regions union all select page_id, x1, -1 from regions) t group by page_id, place),
c as (select page_id, place as "from", lead(place) over (partition by page_id order by place) as "to", cast(sum(change) over (partition by page_id order by place) as bigint) as boxes from e) select * from c where "to" is not null and boxes > 0""")
def projection_profile(spark, sf_dir):
    """G2"""
    return ln.projection(view(spark, sf_dir, "regions"), "x0", "x1")


@query(sql("regions") + """, m as (select *, max(y1) over (partition by page_id order by y0, y1, region_id rows between unbounded preceding and 1 preceding) as furthest from regions where y1 > y0),
n as (select *, sum(case when furthest is null or y0 - furthest + 1 > 1 then 1 else 0 end) over (partition by page_id order by y0, y1, region_id) as island from m)
select page_id, cast(island as bigint) as island, min(y0) as "from", max(y1) as "to", count(*) as boxes from n group by page_id, island""")
def projection_gaps(spark, sf_dir):
    """G3, and the first level of G4"""
    return ln.gaps(view(spark, sf_dir, "regions"), "y0", "y1")


@query(sql("lines", "regions").replace("lines as (", "lines_all as (", 1) + ", lines as (select * from lines_all where conf_milli >= 500 and text <> ''), " + OWNER + ", " + OWNED + _TOLERANCE + _ROWS + ", " + dims.CLASSES_SQL + """,
pos as (select o.*, r.x1 as bx1, lag(o.y0 + o.y1) over w as py, lag(o.x1) over w as px from rows_ o join regions r on r.page_id = o.page_id and r.region_id = o.region_id window w as (partition by o.page_id, o.region_id order by o.position)),
parts as (select *, case when position = 1 then '' when abs(y0 + y1 - py) <= y1 - y0 or px >= bx1 - greatest(8, y1 - y0) then ' ' else chr(10) end || text as part from pos),
blocks as (select page_id, region_id, string_agg(part, '' order by position) as content, count(*) as n_lines from parts group by page_id, region_id)
select b.page_id, row_number() over (partition by b.page_id order by bucket, r.y0, r.x0, b.region_id) as block, b.region_id, label, n_lines, content
from blocks b join regions r on r.page_id = b.page_id and r.region_id = b.region_id join classes c on c.class_id = r.class_id""")
def paragraph_blocks(spark, sf_dir):
    """J1, F1, W2, W5-W7, A10, M6"""
    return ln.paragraph_blocks(*both(spark, sf_dir))
