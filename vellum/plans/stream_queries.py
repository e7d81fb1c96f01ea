"""Queries over documents assembled from pages, recognisers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.recognizer import Digest, recognise
from vellum.operators import assembly
from vellum.plans.registry import query
from vellum.plans.text_queries import _HEADS, _S, _level_sql, heads
from vellum.sources.views import sql, view
from vellum.streaming import metrics


def titles(spark, sf_dir):
    h = heads(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 9 == 7, "Introduction").otherwise(F.col("head")))
    boxed = h.select(F.floor(F.col("doc_id") / 12).alias("doc_id"), (F.col("doc_id") % 12).alias("pos"), "content", (F.col("doc_id") * 7 % 5 * 6 + 12).cast("int").alias("h"))
    return boxed.select("doc_id", "pos", "content", assembly.title_height(F.col("content"), F.lit(0), F.lit(0), F.lit(500), F.col("h")).alias("height"))


@query()
def heading_levels(spark, sf_dir):
    """G18, A17, A18, A19, W15, X13-X15"""
    return assembly.title_levels(assembly.with_height_levels(titles(spark, sf_dir)))


_TITLES = _HEADS + _level_sql().replace(" select doc_id, case", ", nm as (select doc_id, case") + f""" as level from u), hd as (select doc_id // 12 as doc_id, doc_id % 12 as pos, case when doc_id % 9 = 7 then 'Introduction' else head end as content, case when doc_id % 9 = 7 then null else kind end as kind,
 case when doc_id % 9 = 7 then null else level end as own, (doc_id % 4) + 1 as cluster from heads join nm using (doc_id))""".replace(" as level from u)", ")", 1)


@query(_TITLES + """, fr as (select doc_id, kind, row_number() over (partition by doc_id order by min(pos)) as rk from hd where kind is not null group by doc_id, kind), j as (select hd.*, rk, first_value(case when hd.kind = 'NUM_LIST' then own end ignore nulls) over (partition by hd.doc_id order by pos rows between unbounded preceding and current row) as d from hd left join fr on fr.doc_id = hd.doc_id and fr.kind = hd.kind),
r as (select *, case when kind = 'NUM_LIST' then rk + own - d else rk end as rel from j) select doc_id, pos, cast(greatest(1, least(6, case when kind is not null then case when own = rel or own = cluster then own else rel end when content = 'Introduction' then 1 else cluster end)) as int) as level from r""")
def heading_votes(spark, sf_dir):
    """G18 without the clustering of heights"""
    h = heads(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 9 == 7, "Introduction").otherwise(F.col("head")))
    return assembly.title_levels(h.select(F.floor(F.col("doc_id") / 12).alias("doc_id"), (F.col("doc_id") % 12).alias("pos"), "content", (F.col("doc_id") % 4 + 1).alias("cluster")))


@query("""with b as (select p_partkey // 6 as doc_id, p_partkey % 6 as page_index, p_partkey % 5 = 0 as wide, '<tr><td>' || p_brand || '</td><td>' || p_type || case when p_partkey % 5 = 0 then '</td><td>c' else '' end || '</td></tr>' as row_ from part),
r as (select *, row_number() over (partition by doc_id order by page_index) - 1 as rk, case when lag(wide) over w = wide and lag(page_index) over w = page_index - 1 then 0 else 1 end as starts from b window w as (partition by doc_id order by page_index)),
g as (select *, sum(starts) over (partition by doc_id order by page_index) as run from r), h as (select doc_id, run, min(rk) as first_, string_agg(row_, '' order by page_index) as rows_ from g group by doc_id, run)
select doc_id, page_index, 1 as pos, 'table' as label, cast(2 * first_ + 1 as int) as "group", case when rk = first_ then '<table><tr><th>A</th><th>B</th></tr>' || rows_ || '</table>' else '' end as html from g join h using (doc_id, run) union all select doc_id, page_index, 0, 'header', cast(2 * rk as int), 'h' from g""")
def merged_tables(spark, sf_dir):
    """G17, W13, A23"""
    p = view(spark, sf_dir, "part")
    key = F.col("p_partkey")
    html = F.concat(F.lit("<table><tr><th>A</th><th>B</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>"), F.col("p_type"), F.when(key % 5 == 0, "</td><td>c").otherwise(""), F.lit("</td></tr></table>"))
    blocks = p.select(F.floor(key / 6).alias("doc_id"), (key % 6).alias("page_index"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("header").alias("label"), F.lit("h").alias("content")), F.struct(F.lit(1).cast("long").alias("pos"), F.lit("table").alias("label"), html.alias("content")))).alias("b"))
    return assembly.merge_tables(blocks.select("doc_id", "page_index", "b.pos", "b.label", "b.content"))


@query()
def repetition_truncated(spark, sf_dir):
    """G19, X16, X17"""
    return assembly.without_repetition(view(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.md5("text").alias("kept"))


@query(sql("lines") + " select page_id, count(*) as crops, count(*) filter (where line_id % 10 = 0) as errors from lines group by page_id")
def recognised_crops(spark, sf_dir):
    """A stand-in model over crops"""
    crops = view(spark, sf_dir, "lines").select("page_id", F.col("line_id").cast("int").alias("region_id"), F.when(F.col("line_id") % 10 != 0, F.col("text")).cast("binary").alias("content"))
    return recognise(crops, Digest).groupBy("page_id").agg(F.count("*").alias("crops"), F.count("error").alias("errors"))


@query(sql("requests") + """, w as (select date_trunc('day', ts) as "from", route, count(*) as n, count(*) filter (where status < 300) as ok, count(*) filter (where status >= 500) as server_errors from requests group by 1, 2) select * from w where "from" + interval 1 day <= (select max(ts) - interval 1 hour from requests)""")
def stream_route_metrics(spark, sf_dir):
    """Windows that the watermark has closed"""
    return metrics.drained(metrics.windowed_counters(metrics.events_stream(spark, sf_dir, 1000)))


@query(sql("requests") + """, s as (select route, event_id, ts, duration_s > 2.8 as slow, row_number() over (partition by route order by ts, event_id) as k from requests), g as (select *, sum(cast(not slow as int)) over (partition by route order by k) as grp from s)
 select route, event_id, alerts from (select route, event_id, ts, cast(sum(cast(slow as int)) over (partition by route, grp order by k) as bigint) as alerts from g) q where ts <= (select date_trunc('milliseconds', max(ts)) - interval 1 day from requests)""")
def stream_alerts(spark, sf_dir):
    """A counter that slow requests raise and others reset, in the order of their times as far as the watermark has come"""
    return metrics.drained(metrics.running_alerts(metrics.events_stream(spark, sf_dir, 1000)))


@query("""with p as (select conv_id as request_id, turn as page_index, case when turn % 3 = 2 then 'page_error' else 'page' end as event from conversations), g as (select request_id, count(*) as total, count(*) filter (where event = 'page') as pages, count(*) filter (where event = 'page_error') as errors,
 string_agg('{"event":"' || event || '","page_index":' || page_index || '}', chr(10) order by page_index) as body from p group by request_id) select request_id, '{"event":"meta","total":' || total || '}' || chr(10) || body || chr(10) || '{"event":"end","pages":' || pages || ',"errors":' || errors || '}' as lines from g""")
def stream_page_events(spark, sf_dir):
    """Pages as a stream of events into a sink of JSON lines, and the event lines of each request from there"""
    pages = metrics.table_stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("page_index"), (F.col("turn") % 3 == 2).alias("failed"))
    return metrics.closed_requests(metrics.drained(metrics.page_events(pages), form="json"))


@query(sql("requests") + """, q as (select event_id, route, ts, ts + to_milliseconds(event_id * 37 % 9000) as taken_at from requests) select event_id, route from q where taken_at <= ts + interval 5 seconds""")
def stream_deadlines(spark, sf_dir):
    """Requests that a worker takes up before their time is over, from a stream with a bounded number of files a trigger"""
    r = metrics.events_stream(spark, sf_dir, 2)
    taken = r.withColumn("taken_at", F.col("ts") + F.make_dt_interval(secs=((F.col("event_id") * 37 % 9000) / 1000).cast("decimal(18,6)")))
    return metrics.drained(metrics.in_time(taken, 5.0).select("event_id", "route"))
