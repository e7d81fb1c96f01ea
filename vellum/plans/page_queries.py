"""Queries over decoders, requests, PDF text layers, rendering and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import dims
from vellum.operators import layout, pdf, quality, render, requests, sequence
from vellum.operators.lines import page_order
from vellum.plans.layout_queries import BASE, OWNED, both
from vellum.plans.registry import query
from vellum.sources.views import sql, view

# ---- decoders: vectors as eight steps of eight symbols -------------------------------------------------------------------------------------


def steps(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"), "embedding")
    return e.select(F.col("vec_id").alias("seq_id"), "step", F.slice("embedding", F.col("step") * 8 + 1, 8).alias("row"))


_STEPS = "with st as (select vec_id as seq_id, s as step, embedding[s * 8 + 1 : s * 8 + 8] as row_ from embeddings cross join range(8) r(s)), am as (select seq_id, step, list_position(row_, list_max(row_)) - 1 as symbol, list_max(row_) as score from st)"


@query(_STEPS + """, m as (select *, lag(symbol) over (partition by seq_id order by step) as before from am) select seq_id, coalesce(string_agg(cast(symbol as varchar), ',' order by step) filter (where symbol <> 0 and (before is null or before <> symbol)), '') as symbols,
 coalesce(round(avg(score) filter (where symbol <> 0 and (before is null or before <> symbol)), 4), 0) as score from m group by seq_id""")
def ctc_decode(spark, sf_dir):
    """G8, A16, P27"""
    s = steps(spark, sf_dir).select("seq_id", "step", sequence.argmax(F.col("row")).alias("symbol"), F.array_max("row").cast("double").alias("score"))
    out = sequence.ctc_collapse(s)
    return out.select("seq_id", F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols"), F.round("score", 4).alias("score"))


@query(_STEPS + ", a as (select seq_id, list(symbol order by step) as s from am group by seq_id), c as (select seq_id, s, coalesce(list_position(s[2:], 7), 8) as stop from a) select seq_id, array_to_string(list_filter(s[1:stop], lambda x : x <> 0 and x <> 7), ',') as tokens from c")
def structure_decode(spark, sf_dir):
    """Tokens up to the stop"""
    a = steps(spark, sf_dir).select("seq_id", F.struct("step", sequence.argmax(F.col("row")).alias("symbol")).alias("e")).groupBy("seq_id").agg(F.array_sort(F.collect_list("e")).alias("a"))
    tokens = sequence.structure_tokens(F.transform("a", lambda e: e["symbol"]), 0, 7)
    return a.select("seq_id", F.array_join(F.transform(tokens, lambda x: x.cast("string")), ",").alias("tokens"))


@query("""with p as (select vec_id, embedding[1:4] as a, embedding[1:7] as b from embeddings), q as (select *, list_sort(a, 'DESC') as s from p)
select vec_id, round(1.0 / list_sum(list_transform(b, lambda x : exp(x::double - list_max(b)::double))), 6) as confidence, cast(case when s[1] - s[2] < 0.25 then 0 else (list_position(a, list_max(a)) - 1) * 90 end as int) as rotation, a[2] > a[1] and a[2] > 0.1 as flipped from q""")
def model_confidence(spark, sf_dir):
    """P28, P29, P30, R11"""
    e, at = view(spark, sf_dir, "embeddings"), lambda i: F.element_at("embedding", i)
    return e.select("vec_id", F.round(sequence.softmax_confidence(F.slice("embedding", 1, 7)), 6).alias("confidence"), sequence.orientation(F.slice("embedding", 1, 4)).alias("rotation"), sequence.flipped(at(1), at(2), 0.1).alias("flipped"))


# ---- requests -------------------------------------------------------------------------------------------------------------------------------


@query("""with r as (select o_orderkey as id, cast(o_custkey % 3 as int) as p, cast(o_orderkey % 700 as int) as dpi, case o_orderkey % 5 when 0 then 'ocr' when 1 then 'auto' when 2 then 'geometric' when 3 then 'auto_verified' else 'x' end as mode,
 case o_custkey % 6 when 0 then 'TRUE' when 1 then 'off' when 2 then '1' when 3 then 'no' when 4 then 'maybe' else '' end as flag, case o_custkey % 4 when 0 then '12' when 1 then '-3' when 2 then '4x' else '+7' end as num, cast(o_custkey % 20000 as int) as w, cast(o_orderkey % 15000 as int) as h from orders)
select id, case when p = 0 then 'EMPTY_PDF' when dpi not between 50 and 600 then 'INVALID_DPI' when mode not in ('ocr', 'geometric', 'auto', 'auto_verified') then 'INVALID_PARAMETER' end as error,
 case when lower(flag) in ('1', 'true', 'on', 'yes') then 'true' when lower(flag) in ('0', 'false', 'off', 'no') then 'false' end as flag, try_cast(case when regexp_matches(num, '^[+-]?[0-9]{1,9}$') then num end as int) as num,
 case when greatest(w, h) > 16384 then 'dimension' when cast(w as bigint) * h > 128000000 then 'pixels' else 'ok' end as size from r""")
def request_checks(spark, sf_dir):
    """P31, P32, P33, F14"""
    o = view(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n + 1).cast("int"))
    return o.select(
        k.alias("id"), requests.pdf_request_error(c % 3, k % 700, pick(k % 5, "ocr", "auto", "geometric", "auto_verified", "x")).alias("error"), requests.boolean(pick(c % 6, "TRUE", "off", "1", "no", "maybe", "")).cast("string").alias("flag"),
        requests.strict_integer(pick(c % 4, "12", "-3", "4x", "+7")).alias("num"), requests.size_verdict((c % 20000).cast("int"), (k % 15000).cast("int")).alias("size"),
    )


_FLAGS = "select o_orderkey as id, (o_custkey & 1) = 1 as a, (o_custkey & 2) = 2 as b, (o_custkey & 4) = 4 as c, (o_custkey & 8) = 8 as d, (o_custkey & 16) = 16 as e, (o_custkey & 32) = 32 as f from {orders}"


@query("with r as (" + _FLAGS.format(orders="orders") + ") select id, b or c as wants_order, a or b or c or d or e as wants_layout, not f and (d or e or b or c or not (a or b or c or d or e)) as conflict from r")
def option_closure(spark, sf_dir):
    """F12"""
    r = spark.sql(_FLAGS, orders=view(spark, sf_dir, "orders"))
    o = requests.options(*(F.col(x) for x in "abcdef"))
    return r.select("id", o["order"].alias("wants_order"), o["layout"].alias("wants_layout"), o["conflict"].alias("conflict"))


_BATCH = "select o_orderkey DIV 8 as batch_id, o_orderkey % 8 as slot, cast(1000 + (o_custkey * 37) % 5000 as bigint) as pixels from {orders}"


@query("with recursive b as (" + _BATCH.replace("DIV", "//").format(orders="orders") + """), it(batch_id, slot, used, fits) as (select batch_id, slot, case when pixels <= 15000 then pixels else 0 end, pixels <= 15000 from b where slot = 0
 union all select b.batch_id, b.slot, i.used + case when i.used + b.pixels <= 15000 then b.pixels else 0 end, i.used + b.pixels <= 15000 from it i join b on b.batch_id = i.batch_id and b.slot = i.slot + 1) select batch_id, slot, fits from it""")
def batch_budget(spark, sf_dir):
    """F5, F6"""
    return requests.budget(spark.sql(_BATCH.replace("DIV", "div"), orders=view(spark, sf_dir, "orders")), 15000)


_JOBS = "select o_orderkey as id, o_custkey % 4 as pages, o_custkey % 7 = 0 as timed_out, o_orderkey % 5 as dropped, o_orderkey % 3 as decode_failures, o_custkey % 3 as page_failures from {orders}"


@query("with j as (" + _JOBS.format(orders="orders") + ") select *, case when pages = 0 then 'empty' when timed_out then 'timed_out' when dropped > 0 then 'dropped' when decode_failures > 0 then 'decode_failed' when page_failures > 0 then 'page_failed' else 'ok' end as status from j")
def job_status(spark, sf_dir):
    """R7"""
    return requests.job_status(spark.sql(_JOBS, orders=view(spark, sf_dir, "orders")))


_DEGRADED = "select o_orderkey DIV 6 as doc_id, o_orderkey % 6 as page_index, o_custkey % 3 = 0 as text_degraded, o_custkey % 5 = 0 as table_degraded, o_custkey % 7 = 0 as formula_degraded from {orders}"


@query("with d as (" + _DEGRADED.replace("DIV", "//").format(orders="orders") + """), s as (select doc_id, string_agg(cast(page_index + 1 as varchar), ',' order by page_index) filter (where text_degraded) as a, string_agg(cast(page_index + 1 as varchar), ',' order by page_index) filter (where table_degraded) as b,
 string_agg(cast(page_index + 1 as varchar), ',' order by page_index) filter (where formula_degraded) as c from d group by doc_id) select doc_id, concat_ws('; ', 'text(p' || a || ')', 'table(p' || b || ')', 'formula(p' || c || ')') as degraded from s""")
def degraded_summary(spark, sf_dir):
    """K7"""
    return requests.degraded_summary(spark.sql(_DEGRADED.replace("DIV", "div"), orders=view(spark, sf_dir, "orders")))


@query("""with c as (select conv_id as page_id, case when turn % 3 = 2 then ' ' when turn % 5 = 4 then null else text end as reply from conversations), s as (select page_id, count(*) as n, count(*) filter (where coalesce(trim(reply), '') = '') as bad from c group by page_id)
select page_id, n, bad, bad > 0 as degraded, case when bad > 0 then bad || ' of ' || n || ' regions failed' end as message from s""")
def stage_degraded(spark, sf_dir):
    """A13, J18"""
    c = view(spark, sf_dir, "conversations")
    reply = F.when(F.col("turn") % 3 == 2, " ").when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(F.col("text"))
    return requests.stage_degraded(c.select(F.col("conv_id").alias("page_id"), reply.alias("reply")))


@query("""with r as (select o_orderkey as id, o_custkey % 4 as boxes, o_custkey % 3 as results, o_orderkey % 2 as dropped from orders) select id, (boxes > 0 and results = 0) or dropped > 0 as degraded,
 nullif(concat_ws('; ', case when boxes > 0 and results = 0 then boxes || ' regions gave no text' end, case when dropped > 0 then dropped || ' crops dropped' end), '') as message from r""")
def text_degraded(spark, sf_dir):
    """A14"""
    o = view(spark, sf_dir, "orders")
    flag, message = requests.text_degraded(F.col("o_custkey") % 4, F.col("o_custkey") % 3, F.col("o_orderkey") % 2)
    return o.select(F.col("o_orderkey").alias("id"), flag.alias("degraded"), message.alias("message"))


# ---- PDF text layers ------------------------------------------------------------------------------------------------------------------------

_PAGES = """select doc_id, cast(length(text) as int) as chars, case when doc_id % 10 = 0 then 90 else 0 end as rotation, cast(case when doc_id % 7 = 0 then length(text) / 10 else 0 end as int) as replaced, cast(case when doc_id % 11 = 0 then length(text) / 5 else 0 end as int) as controls,
 case when doc_id % 13 = 0 then 0 else 5 end as lines, case doc_id % 3 when 0 then 'auto' when 1 then 'geometric' else 'auto_verified' end as mode, doc_id % 4 = 1 as layout, doc_id % 17 = 0 as images from {documents}"""


@query("with p as (" + _PAGES.format(documents="documents") + """), q as (select *, case when chars = 0 then 'absent' when rotation <> 0 then 'rejected' when chars < 10 then 'absent' when replaced * 20 > chars or controls * 10 > chars then 'rejected' when lines = 0 then 'absent' else 'trusted' end as quality from p)
select doc_id, quality, case when mode = 'auto' then case when quality = 'trusted' then 'geometric' else 'ocr' end else mode end as resolved, case when mode = 'geometric' then layout when mode = 'auto' then quality <> 'trusted' or layout else true end or images as drawn from q""")
def page_modes(spark, sf_dir):
    """F8, R5"""
    p = spark.sql(_PAGES, documents=view(spark, sf_dir, "documents"))
    p = p.withColumn("quality", pdf.layer_quality(*(F.col(k) for k in ("chars", "rotation", "replaced", "controls", "lines"))))
    resolved, drawn = pdf.resolve_mode(*(F.col(k) for k in ("mode", "quality", "layout", "images")))
    return p.select("doc_id", "quality", resolved.alias("resolved"), drawn.alias("drawn"))


def page_texts(spark, sf_dir):
    """Turns of conversations as the text layers of pages, with tabs and line ends of every kind."""
    return view(spark, sf_dir, "conversations").select(((F.col("conv_id") * 10) + F.col("turn")).alias("doc_id"), F.concat("text", F.lit("\n\ttail  \r\n")).alias("text"))


def characters(spark, sf_dir):
    """Every character of these texts with a box, sixty to a row."""
    c = page_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "")).alias("idx", "ch")).where("ch <> ''")
    return c.select("doc_id", "idx", "ch", (F.col("idx") % 60 * 5).alias("x0"), (F.floor(F.col("idx") / 60) * 12).cast("int").alias("y0"), (F.col("idx") % 60 * 5 + 5).alias("x1"), (F.floor(F.col("idx") / 60) * 12 + 10).cast("int").alias("y1"))


#: Code points in a piece of a page: whole rows of sixty.
PIECE = 6000


def layers(spark, sf_dir):
    """The same characters with the same boxes, a page to a row, or a piece of a long page."""
    n, first = F.char_length("text"), F.floor(F.col("start") / 60).cast("int")
    rows = F.floor(n / 60).cast("int") + 1
    across = lambda x: F.slice(F.flatten(F.array_repeat(F.array(*(F.lit(k * 5 + x) for k in range(60))), rows)), 1, n)
    down = lambda y: F.slice(F.flatten(F.transform(F.sequence(first, first + rows - 1), lambda r: F.array_repeat(r * 12 + y, 60))), 1, n)
    return pdf.in_pieces(page_texts(spark, sf_dir), PIECE).select("doc_id", "start", "text", across(0).alias("x0"), down(0).alias("y0"), across(5).alias("x1"), down(10).alias("y1"))


_CHARS = r"""with d as (select conv_id * 10 + turn as doc_id, text || chr(10) || chr(9) || 'tail  ' || chr(13) || chr(10) as text from conversations), ch as materialized (select doc_id, i as idx, substr(text, i + 1, 1) as ch, i % 60 * 5 as x0, i // 60 * 12 as y0, i % 60 * 5 + 5 as x1, i // 60 * 12 + 10 as y1
 from (select doc_id, text, unnest(range(0, length(text))) as i from d) t)"""


@query(_CHARS + """, n as (select *, sum(cast(ch in (chr(10), chr(13)) as int)) over (partition by doc_id order by idx) as line from ch), l as (select doc_id, line, rtrim(string_agg(ch, '' order by idx)) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from n where ch not in (chr(10), chr(13)) and (ascii(ch) >= 32 or ch = chr(9)) group by doc_id, line)
select doc_id, cast(line as bigint) as line, text, x0, y0, x1, y1 from l where text <> ''""")
def text_layer_lines(spark, sf_dir):
    """S9, G7"""
    return pdf.lines_of(characters(spark, sf_dir))


_BOXES = "select distinct doc_id, 0 as box_id, 10 as x0, 0 as y0, 150 as x1, 30 as y1 from {c} union all select distinct doc_id, 1, 100, 10, 300, 60 from {c} union all select distinct doc_id, 2, 0, 0, 20, 2 from {c}"


@query(_CHARS + ", bx as materialized (" + _BOXES.format(c="d") + ") select c.doc_id, b.box_id, string_agg(ch, '' order by idx) as text from ch c join bx b on b.doc_id = c.doc_id and c.x0 + c.x1 >= 2 * b.x0 and c.x0 + c.x1 <= 2 * b.x1 and c.y0 + c.y1 >= 2 * b.y0 and c.y0 + c.y1 <= 2 * b.y1 group by c.doc_id, b.box_id")
def text_in_boxes(spark, sf_dir):
    """S10"""
    return pdf.text_in_boxes(layers(spark, sf_dir), spark.sql(_BOXES, c=page_texts(spark, sf_dir)))


@query(_CHARS + ", bx as materialized (" + _BOXES.format(c="d") + """), nt as (select c.doc_id, b.box_id, string_agg(ch, '' order by idx) as native from ch c join bx b on b.doc_id = c.doc_id and c.x0 + c.x1 >= 2 * b.x0 and c.x0 + c.x1 <= 2 * b.x1 and c.y0 + c.y1 >= 2 * b.y0 and c.y0 + c.y1 <= 2 * b.y1 group by c.doc_id, b.box_id),
g as (select b.*, native, coalesce(length(native) > 0 and length(native) * 60 >= x1 - x0 and length(native) <= x1 - x0, false) as good from bx b left join nt n on n.doc_id = b.doc_id and n.box_id = b.box_id) select doc_id, box_id, case when good then native else 'seen' end as text, case when good then 'pdf' else 'ocr' end as source from g""")
def verified_results(spark, sf_dir):
    """J14, F9"""
    boxes = spark.sql(_BOXES, c=page_texts(spark, sf_dir))
    return pdf.verify_with_layer(boxes.withColumn("text", F.lit("seen")), pdf.text_in_boxes(layers(spark, sf_dir), boxes))


# ---- rendering ------------------------------------------------------------------------------------------------------------------------------


@query(sql("lines") + """, l as (select page_id, line_id, case when line_id % 9 = 0 then 'x' else text end as text from lines), p as (select page_id, string_agg(text, chr(10) || chr(10) order by line_id) filter (where length(text) >= 2) as md from l group by page_id) select page_id, md || chr(10) as markdown from p""")
def markdown_without_layout(spark, sf_dir):
    """M2, F7"""
    return render.without_layout(view(spark, sf_dir, "lines").withColumn("text", F.when(F.col("line_id") % 9 == 0, "x").otherwise(F.col("text"))))


_PARTS = BASE + ", " + OWNED + ", " + dims.CLASSES_SQL + """, rk as (select l.*, o.region_id, row_number() over (partition by l.page_id order by l.y0 + l.y1, l.x0 + l.x1, l.line_id) - 1 as rank_ from lines l join owner o using (page_id, line_id)),
tx as (select page_id, region_id, string_agg(text, ' ' order by rank_) as text, min(rank_) as first_ from rk where region_id is not null group by page_id, region_id),
tb as (select page_id, region_id, '<table><tr><td>' || region_id || '</td></tr></table>' as html from regions where class_id = 21 and region_id % 2 = 0), fm as (select page_id, region_id, 'x_' || region_id as latex from regions where class_id in (5, 15) and region_id % 3 <> 0),
nf as (select n.page_id, n.region_id as number, f.region_id as formula, row_number() over (partition by n.page_id, n.region_id order by abs(n.x0 - f.x1), f.region_id) as rn from regions n join regions f on n.page_id = f.page_id and n.class_id = 11 and f.class_id = 5 and (n.y0 + n.y1) // 2 between f.y0 and f.y1),
tg as (select nf.page_id, number, formula, tx.text as tag from nf join tx on tx.page_id = nf.page_id and tx.region_id = nf.number where rn = 1 and tx.text <> ''), tf as (select page_id, formula, arg_max(tag, number) as tag from tg group by page_id, formula),
nl as (select r.page_id, r.region_id, l.rank_, row_number() over (partition by r.page_id, r.region_id order by (l.x0 + l.x1 - r.x0 - r.x1) * cast(l.x0 + l.x1 - r.x0 - r.x1 as bigint) + (l.y0 + l.y1 - r.y0 - r.y1) * cast(l.y0 + l.y1 - r.y0 - r.y1 as bigint), l.line_id) as rn from regions r join rk l on l.page_id = r.page_id),
fl as (select r.*, c.label, c.bucket, coalesce(tx.text, '') as text, tx.first_, tb.html, fm.latex, tf.tag, exists (select 1 from tg where tg.page_id = r.page_id and tg.number = r.region_id) as used, nl.rank_ as near from regions r join classes c on c.class_id = r.class_id left join tx on tx.page_id = r.page_id and tx.region_id = r.region_id left join tb on tb.page_id = r.page_id and tb.region_id = r.region_id
 left join fm on fm.page_id = r.page_id and fm.region_id = r.region_id left join tf on tf.page_id = r.page_id and tf.formula = r.region_id left join nl on nl.page_id = r.page_id and nl.region_id = r.region_id and nl.rn = 1),
pt as (select *, case when used or class_id in (11, 12, 13, 8, 9, 16, 20) then '' when class_id = 21 then coalesce(html, text) when class_id = 5 then case when latex is null then text else '$$' || chr(10) || latex || coalesce(' \\tag{' || tag || '}', '') || chr(10) || '$$' end
 when class_id = 15 then case when latex is null then text else '$' || latex || '$' end when label in ('image', 'chart') then '![' || text || '](block' || region_id || '.png)' when text = '' then '' when label = 'doc_title' then '# ' || text when label = 'paragraph_title' then '## ' || text when label = 'figure_title' then '### ' || text
 when label = 'abstract' then '**Abstract** ' || text when label = 'algorithm' then '```' || chr(10) || text || chr(10) || '```' when label in ('reference', 'reference_content') then '- ' || text else text end as part, coalesce(first_, near + 0.5, 1000000000 + y0) as key_ from fl),
pl as (select *, row_number() over (partition by page_id order by bucket, key_, y0, x0, region_id) as place, label in ('reference', 'reference_content') as ref from pt where part <> ''),
parts as (select page_id, region_id, place, case when ref and sum(cast(ref as int)) over (partition by page_id order by place) = 1 then '### References' || chr(10) || chr(10) || part else part end as part from pl)"""


def parts(spark, sf_dir, image_source=render.block_image):
    lines, regions = both(spark, sf_dir)
    ranked = render.line_ranks(page_order(layout.with_owner(lines, regions)).withColumnRenamed("position", "place"))
    key = F.col("region_id")
    tables = regions.where("class_id = 21 and region_id % 2 = 0").select("page_id", "region_id", F.lit(1).alias("seq"), F.concat(F.lit("<p>a</p><table><tr><td>"), key.cast("string"), F.lit("</td></tr></table>b")).alias("html"))
    formulas = regions.where("class_id in (5, 15) and region_id % 3 <> 0").select("page_id", "region_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), key.alias("k")).select("page_id", "region_id", "seq", F.concat(F.when(F.col("seq") == 2, "x_").otherwise("old_"), F.col("k").cast("string")).alias("latex"))
    return render.markdown_parts(regions, ranked, tables, formulas, image_source)


@query(_PARTS + " select * from parts")
def markdown_parts(spark, sf_dir):
    """M1, M3, M4, M5, J10, J11, J12, W4, W5, W14, F7, A11"""
    return parts(spark, sf_dir)


@query(_PARTS + " select page_id, string_agg(part, chr(10) || chr(10) order by place) || chr(10) as markdown from parts group by page_id")
def page_markdown(spark, sf_dir):
    """M1"""
    return render.markdown(parts(spark, sf_dir))


@query(_PARTS + ", mk as (select page_id, string_agg(part, chr(10) || chr(10) order by place) || chr(10) as markdown from parts group by page_id) select page_id // 4 as doc_id, string_agg('<!-- page ' || (page_id % 4 + 1) || ' -->' || chr(10) || chr(10) || markdown, chr(10) || chr(10) order by page_id) as markdown from mk group by 1")
def document_markdown(spark, sf_dir):
    """K6"""
    return render.document_markdown(render.markdown(parts(spark, sf_dir)), 4)


@query(sql("regions") + ", " + dims.CLASSES_SQL + " select page_id, region_id, label as kind, 'block' || region_id || '.png' as path, x0, y0, x1, y1 from regions join classes using (class_id) where label in ('image', 'chart')")
def asset_manifest(spark, sf_dir):
    """K10, M5"""
    return render.assets(view(spark, sf_dir, "regions"))


@query(BASE + " select page_id, count(*) as results, count(region_id) as owned, min(text) as first_text from lines join owner using (page_id, line_id) group by page_id")
def page_json(spark, sf_dir):
    """Pages as JSON, read back"""
    lines, regions = both(spark, sf_dir)
    j = render.page_json(layout.with_owner(lines, regions), regions)
    parsed = j.select("page_id", F.from_json("json", "results array<struct<id:bigint,text:string,confidence:double,layout_id:int>>, layout array<struct<id:int,`class`:string>>").alias("p"))
    r = F.col("p.results")
    return parsed.select("page_id", F.size(r).cast("long").alias("results"), F.size(F.filter(r, lambda e: e["layout_id"].isNotNull())).cast("long").alias("owned"), F.array_min(F.transform(r, lambda e: e["text"])).alias("first_text"))


@query("""with s as (select conv_id as batch_id, turn as slot, case when turn % 3 = 2 then null else text end as text, case when turn % 3 = 2 then 'base64_decode_failed' end as error from conversations)
select batch_id, sha256(array_to_string(list(coalesce(text, '') order by slot), '|')) as results, array_to_string(list(coalesce(error, '') order by slot), '|') as errors from s group by batch_id""")
def batch_json(spark, sf_dir):
    """K8, S6"""
    c = view(spark, sf_dir, "conversations")
    bad = F.col("turn") % 3 == 2
    j = render.batch_json(c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("slot"), F.when(~bad, F.col("text")).alias("text"), F.when(bad, "base64_decode_failed").alias("error")))
    p = j.select("batch_id", F.from_json("json", "results array<string>, errors array<string>").alias("p"))
    return p.select("batch_id", F.sha2(F.array_join("p.results", "|"), 256).alias("results"), F.array_join("p.errors", "|").alias("errors"))


@query("select conv_id, turn, text as content from conversations where role = 'assistant'")
def chat_replies(spark, sf_dir):
    """Content of chat replies"""
    c = view(spark, sf_dir, "conversations").where("role = 'assistant'")
    body = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices")))
    return c.select("conv_id", "turn", F.get_json_object(body, "$.choices[0].message.content").alias("content"))


# ---- scores, metrics and drift --------------------------------------------------------------------------------------------------------------

_PAIRS = "select a.doc_id as id, a.text as expected, b.text as actual, a.lang, a.source from {documents} a join {documents} b on b.doc_id = a.doc_id + 1 where a.doc_id % 2 = 0"


def pairs(spark, sf_dir):
    return spark.sql(_PAIRS, documents=view(spark, sf_dir, "documents"))


_SCORES = "with pr as (" + _PAIRS.format(documents="documents") + """), ew as (select id, w, count(*) as n from (select id, unnest(regexp_extract_all(lower(expected), '[a-z0-9]+')) as w from pr) t group by id, w), aw as (select id, w, count(*) as n from (select id, unnest(regexp_extract_all(lower(actual), '[a-z0-9]+')) as w from pr) t group by id, w),
j as (select coalesce(e.id, a.id) as id, coalesce(e.n, 0) as e, coalesce(a.n, 0) as a from ew e full join aw a on a.id = e.id and a.w = e.w), s as (select id, sum(least(e, a)) as b, sum(e) as e, sum(a) as a, count(*) filter (where e > 0 and a > 0) as sb, count(*) filter (where e > 0) as se from j group by id),
f as (select id, case when a > 0 then b / a else 0 end as precision_, case when e > 0 then b / e else 0 end as recall_, case when se > 0 then sb / se else 0 end as set_recall from s), sc as (select pr.id, coalesce(precision_, 1) as precision, coalesce(recall_, 1) as recall, case when precision_ is null then 1 when precision_ + recall_ > 0 then 2 * precision_ * recall_ / (precision_ + recall_) else 0 end as f1, coalesce(set_recall, 1) as set_recall from pr left join f using (id))"""


@query(_SCORES + " select * from sc")
def word_scores(spark, sf_dir):
    """A29, A30, U3, U4, X11"""
    return quality.word_scores(pairs(spark, sf_dir))


@query()
def character_errors(spark, sf_dir):
    """A row for every pair; the edits of A33 are over the longer text"""
    # Long texts take seconds a pair, so pairs are dealt anew, to a number of tasks that is kept however small they are.
    p = quality.with_edits(pairs(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"))
    e, a, edits = F.col("expected"), F.col("actual"), F.col("edits")
    longer = F.greatest(e, a)
    edit = F.when(longer == 0, 0.0).otherwise(edits / longer)
    return p.select("id", quality.character_error(e, a, edits).alias("cer"), quality.overall(edit, F.lit(0.5), F.lit(0.25)).alias("overall"), (a / F.nullif(e, F.lit(0))).alias("ratio"))


@query(_SCORES + " select p.lang, p.source, count(*) as n, avg(f1) as mean from pr p join sc using (id) group by grouping sets ((lang), (source), ())")
def sliced_means(spark, sf_dir):
    """A34"""
    p = pairs(spark, sf_dir)
    return quality.sliced_means(quality.word_scores(p).join(p.select("id", "lang", "source"), "id").withColumn("score", F.col("f1")))


@query("""with e as (select conv_id as doc_id, turn as page, text from conversations), a as (select conv_id as doc_id, turn + 1 as page, role as text from conversations where turn % 4 <> 3) select e.doc_id, e.page - min(e.page) over (partition by e.doc_id) as page, e.text as expected, coalesce(a.text, '') as actual
 from e left join (select *, page - min(page) over (partition by doc_id) as p0 from a) a on a.doc_id = e.doc_id and a.p0 = e.page""")
def aligned_pages(spark, sf_dir):
    """J16"""
    c = view(spark, sf_dir, "conversations")
    expected = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    actual = c.where("turn % 4 <> 3").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.col("role").alias("text"))
    return quality.aligned_pages(expected, actual)


@query("with b as (select event_type || user_id % 4 as metric, avg(value) as value from events where user_id % 4 <> 1 group by 1), c as (select event_type || user_id % 4 as metric, avg(value) as value from events where user_id % 4 <> 2 and user_id % 3 <> 0 group by 1) select coalesce(b.metric, c.metric) as metric, b.value as before, c.value as after, c.value - b.value as change from b full join c on b.metric = c.metric")
def run_comparison(spark, sf_dir):
    """J17"""
    e = view(spark, sf_dir, "events").withColumn("metric", F.concat("event_type", (F.col("user_id") % 4).cast("string")))
    run = lambda rows: rows.groupBy("metric").agg(F.avg("value").alias("value"))
    return quality.compare_runs(run(e.where("user_id % 4 <> 1")), run(e.where("user_id % 4 <> 2 and user_id % 3 <> 0")))


@query(sql("requests") + ", k as (select route, duration_s, row_number() over (partition by route order by duration_s) - 1 as r, count(*) over (partition by route) as n from requests) select route, max(duration_s) filter (where r = cast(floor(n * 0.5) as int)) as p50, max(duration_s) filter (where r = cast(floor(n * 0.95) as int)) as p95, max(duration_s) filter (where r = cast(floor(n * 0.99) as int)) as p99 from k group by route")
def latency_percentiles(spark, sf_dir):
    """A27"""
    return quality.percentiles(view(spark, sf_dir, "requests"), "route", "duration_s")


_COUNTERS = sql("requests") + ", c as (select route, count(*) filter (where status between 200 and 299) as ok, count(*) filter (where status between 400 and 499) as client_errors, count(*) filter (where status >= 500) as server_errors, count(*) as n, cast(sum(floor(duration_s * 1e6)) as bigint) as micros, cast(sum(bytes) as bigint) as bytes from requests group by route)"


@query(_COUNTERS + " select * from c")
def route_counters(spark, sf_dir):
    """A25, A28, Z5 (batch twin)"""
    return quality.route_counters(view(spark, sf_dir, "requests"))


@query(_COUNTERS + """ select route, 'requests_total{route="' || route || '",status="2xx"} ' || ok || chr(10) || 'requests_total{route="' || route || '",status="4xx"} ' || client_errors || chr(10) || 'requests_total{route="' || route || '",status="5xx"} ' || server_errors as text from c""")
def metrics_exposition(spark, sf_dir):
    """K12"""
    return quality.exposition(quality.route_counters(view(spark, sf_dir, "requests")))


@query(sql("requests") + ", b as (select * from (values (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (5.0), (null)) v(le)), t as (select distinct route from requests) select t.route, cast(b.le as double) as le, cast((select count(*) from requests r where r.route = t.route and (b.le is null or r.duration_s <= b.le)) as bigint) as n from t cross join b")
def latency_histogram(spark, sf_dir):
    """A26"""
    return quality.latency_histogram(view(spark, sf_dir, "requests"))


_RUNS = "select event_type as scenario, user_id as seq, cast(200 + (user_id * 7) % 30 + case when user_id % 11 = 0 then 40 when user_id % 13 = 0 then 85 else 0 end as double) as p50, case when user_id % 17 = 0 then 0.2 else 0.0 end as err_rate from {events} group by event_type, user_id"


_VERDICTS = ("with recursive r0 as (" + _RUNS.format(events="events") + """), r as (select *, row_number() over (partition by scenario order by seq) as k from r0),
it(scenario, k, seq, passed, alerts, verdict) as (select scenario, cast(0 as bigint), cast(null as bigint), cast([] as double[]), 0, cast('' as varchar) from (select distinct scenario from r) s
 union all select i.scenario, r.k, r.seq, case when x.v = 'PASS' then list_append(i.passed, r.p50) else i.passed end,
  case when x.v = 'PASS' then 0 when x.v in ('ALERT', 'HALT') and not (r.err_rate > 0.1) and r.p50 <= 280 and len(i.passed) > 0 and r.p50 > y.b * 1.05 and not (r.p50 > y.b * 1.1) then i.alerts + 1 else i.alerts end, x.v
 from it i join r on r.scenario = i.scenario and r.k = i.k + 1, lateral (select list_median(i.passed[greatest(1, len(i.passed) - 2):]) as b) y,
  lateral (select case when r.err_rate > 0.1 then 'INFRA' when r.p50 > 300 then 'HALT' when len(i.passed) = 0 then 'PASS' when r.p50 > y.b * 1.1 then 'HALT' when r.p50 > 280 then 'ALERT' when r.p50 > y.b * 1.05 then case when i.alerts >= 1 then 'HALT' else 'ALERT' end else 'PASS' end as v) x),
v as (select scenario, seq, verdict from it where k > 0)""")


@query(_VERDICTS + " select * from v")
def drift_verdicts(spark, sf_dir):
    """W11, W12, Z6 (batch twin)"""
    return quality.verdicts(spark.sql(_RUNS, events=view(spark, sf_dir, "events")))


@query(_VERDICTS + " select scenario, seq, p50, back from (select scenario, seq, p50, row_number() over (partition by scenario order by seq desc) as back from v join r using (scenario, seq) where verdict = 'PASS') q where back <= 6")
def retained_passes(spark, sf_dir):
    """The last six runs of a scenario that passed"""
    runs = spark.sql(_RUNS, events=view(spark, sf_dir, "events"))
    return quality.last_passes(runs, quality.verdicts(runs))
