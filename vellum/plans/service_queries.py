"""Queries over requests, routing, envelopes, decoding and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import backends, dims, latex, recognizer, tablefunctions
from vellum.functions import geometry as g
from vellum.functions import text as t
from vellum.operators import detection, layout, pdf, quality, render, requests, sampling, sequence
from vellum.plans.layout_queries import BASE, OWNED, both, route_regions
from vellum.plans.page_queries import _CHARS, _STEPS, characters, parts, steps
from vellum.plans.registry import ORACLES, query
from vellum.plans.text_queries import html_tables
from vellum.sources import files
from vellum.sources.views import sql, view

# ---- requests -------------------------------------------------------------------------------------------------------------------------------

_GIVEN = """select o_orderkey as request_id, case o_custkey % 3 when 0 then '/ocr' when 1 then '/ocr/pdf' else '/ocr/pixels' end as endpoint, name, value from {orders}, (values ('layout', '1', 2), ('dpi', '100', 3), ('width', '5', 5), ('route_table', 'strong', 7),
 ('route_formula', 'nobody', 11), ('embed', '0', 4), ('colour', 'red', 9), ('route_table', '', 6)) v(name, value, every) where o_orderkey % every = 0"""
_ENDPOINTS = {"/ocr": ("options", "routing"), "/ocr/pdf": ("options", "pdf"), "/ocr/pixels": ("options", "pixels")}
_SUPPORTED = "(endpoint = '/ocr' and name in ('layout', 'route_table', 'route_formula') or endpoint = '/ocr/pdf' and name in ('layout', 'dpi') or endpoint = '/ocr/pixels' and name in ('layout', 'width'))"


def _checks(strict: bool) -> str:
    first = f"max(case when name not like 'route%' and not {_SUPPORTED} then 1 else 0 end)" if strict else "0"
    return f"""with given as ({_GIVEN.format(orders='orders')}), f as (select request_id, {first} as strict_fault, max(case when name like 'route%' and value <> '' and not {_SUPPORTED} then 1 else 0 end) as refused,
 max(case when name like 'route%' and value <> '' and {_SUPPORTED} and not (name = 'route_table' and value = 'strong') then 1 else 0 end) as unknown, list_sort(list(distinct name) filter (where name in ('layout', 'dpi', 'width', 'embed') and not {_SUPPORTED})) as ignored from given group by request_id)
 select request_id, case when strict_fault = 1 or refused = 1 then 'INVALID_PARAMETER' when unknown = 1 then 'ROUTING_UNKNOWN_OVERRIDE' end as error, array_to_string({"[]" if strict else "coalesce(ignored, [])"}, ',') as ignored from f"""


def checked(spark, sf_dir, strict):
    given = spark.sql(_GIVEN, orders=view(spark, sf_dir, "orders"))
    endpoints = spark.createDataFrame([(k, list(v)) for k, v in _ENDPOINTS.items()], "endpoint string, groups array<string>")
    known = spark.createDataFrame([("route_table", "strong")], "parameter string, backend string")
    out = requests.parameter_checks(given, endpoints, known, strict)
    names = F.filter("ignored", lambda x: x != "colour")
    return out.select("request_id", "error", F.array_join(names, ",").alias("ignored"))


@query(_checks(False))
def parameter_checks(spark, sf_dir):
    """what endpoints make of parameters that they don't support"""
    return checked(spark, sf_dir, False)


@query(_checks(True))
def strict_parameter_checks(spark, sf_dir):
    """the same where unknown parameters are errors"""
    return checked(spark, sf_dir, True)


@query("select o_orderkey as id, case when o_custkey % 2 = 1 and o_custkey % 3 <> 0 then 'TABLE_BACKEND_DISABLED' when o_custkey % 5 = 0 and o_custkey % 7 <> 0 then 'FORMULA_BACKEND_DISABLED' end as error from orders")
def backend_gate(spark, sf_dir):
    """F13"""
    c = F.col("o_custkey")
    return view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), requests.structure_backends(c % 2 == 1, c % 3 == 0, c % 5 == 0, c % 7 == 0).alias("error"))


@query("""select o_orderkey as id, case when o_custkey % 2 not in (1) then 'INVALID_DIMENSIONS' when greatest(o_custkey % 20000, 40) > 16384 then 'DIMENSIONS_TOO_LARGE' when o_orderkey % 9 = 0 then 'EMPTY_BODY' when o_orderkey % 4 = 0 then 'BODY_SIZE_MISMATCH' end as error from (select *, o_custkey % 20000 + 1 as w from orders) q""".replace("greatest(o_custkey % 20000, 40)", "greatest(w, 40)"))
def pixel_bodies(spark, sf_dir):
    """Raw bodies against their sizes"""
    o = view(spark, sf_dir, "orders")
    w, channels = (F.col("o_custkey") % 20000 + 1).cast("int"), F.when(F.col("o_custkey") % 2 == 1, 3).otherwise(2)
    size = w.cast("long") * 40 * channels
    length = F.when(F.col("o_orderkey") % 9 == 0, F.lit(0)).when(F.col("o_orderkey") % 4 == 0, size - 1).otherwise(size)
    return o.select(F.col("o_orderkey").alias("id"), files.pixel_error(length, w, F.lit(40), channels).alias("error"))


_LANGS = "select o_orderkey as id, case o_custkey % 5 when 0 then 'small' when 1 then 'nothing' else '' end as model, case o_orderkey % 4 when 0 then 'greek' when 1 then 'chinese' when 2 then 'thai' else null end as lang, case when o_orderkey % 6 = 0 then 'my.onnx' else '' end as own_rec, '' as own_dict, cast(null as varchar(9)) as own_det from {orders}"
_MODELS = "(values " + ", ".join(f"('{n}', '{r}', '{d}', '{x}')" for n, r, d, x, _ in dims.MODELS) + ") m(name, rec, dict, det)"


@query("with r as (" + _LANGS.format(orders="orders") + "), n as (select *, case when model = 'small' then 'small' when model = '' and lang in ('greek', 'thai') then lang else 'tiny' end as name from r) select id, n.name, case when own_rec <> '' then own_rec else rec end as rec, dict, det, case when model = 'nothing' then 'unknown_model' end as fault from n join " + _MODELS + " on m.name = n.name")
def model_paths(spark, sf_dir):
    """Models and dictionaries by name or language"""
    return dims.with_model(spark.sql(_LANGS, orders=view(spark, sf_dir, "orders")))


_CAPABILITIES = """{"build":"gpu","features":{"layout":true,"tables":true,"formulas":false,"autorotate":false,"profile_endpoint":false,"grpc_response_mode":"structured"},"pdf":{"modes":["ocr","geometric","auto","auto_verified"],"default_dpi":100,"max_pages":2000},"limits":{"max_body_mb":64,"max_image_dim":16384,"max_batch_images":32},"endpoints":["/health","/health/live","/health/ready","/metrics","/capabilities","/ocr","/ocr/raw","/ocr/batch","/ocr/pixels","/ocr/pdf","/ocr/markdown","/infer","/ocr/stream"],"routing":{"routes":{"table":"strong"},"backends":{"strong":{"kind":"openai"}}}}"""


@query(f"select '{_CAPABILITIES}' as document")
def capability_document(spark, sf_dir):
    """K13"""
    routing = backends.Routing.parse('{"backends": {"strong": {"kind": "openai", "url": "http://model", "model": "m"}}, "routes": {"table": "strong"}}')
    text = backends.capabilities(routing, True, {"layout": True, "tables": True}, {"max_body_mb": 64, "max_image_dim": 16384, "max_batch_images": 32})
    return spark.createDataFrame([(text,)], "document string")


# ---- routing and inference --------------------------------------------------------------------------------------------------------------------

_VERDICTS = "select page_id, region_id, region_id % 3 <> 0 as is_table, case when region_id % 2 = 0 then 'wired' else 'wireless' end as kind from {regions} where page_id % 5 <> 0"


@query("with routed as (" + ORACLES["route_regions"] + "), " + sql("regions").removeprefix("with ") + ", v as (" + _VERDICTS.format(regions="regions") + """) select r.page_id, r.region_id, tier, case when asked and not is_table then 'text' else dest end as dest, case when asked and not is_table then 'none' else wrap end as wrap,
 case when asked and not is_table then 'table_verify_demoted' else reason end as reason, case when asked and is_table then kind end as hint from (select r.*, v.is_table, v.kind, r.dest = 'table' and r.tier = 'verify' and v.is_table is not null as asked from routed r left join v on v.page_id = r.page_id and v.region_id = r.region_id) r""")
def verified_routes(spark, sf_dir):
    """Tables in doubt that a classifier confirms or demotes"""
    return layout.verified_route(route_regions(spark, sf_dir), spark.sql(_VERDICTS, regions=view(spark, sf_dir, "regions")))


@query("select doc_id as id, case when doc_id % 3 = 2 then 0 when doc_id % 7 = 0 then 0 else 8 end as n, case when doc_id % 3 <> 2 and doc_id % 7 = 0 then 'empty_crop' end as error from documents")
def single_regions(spark, sf_dir):
    """Each image as one region, by the model of its modality (a stand-in)"""
    modality = F.when(F.col("doc_id") % 3 == 0, "table").when(F.col("doc_id") % 3 == 1, "formula").otherwise("poem")
    images = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), modality.alias("modality"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("x"), "text")).cast("binary").alias("content"))
    return recognizer.infer_regions(images, {"table": recognizer.Digest, "formula": recognizer.Digest}).select("id", F.char_length("text").alias("n"), "error")


@query(BASE + " select l.page_id, l.line_id, r.region_id from lines l join regions r on r.page_id = l.page_id and l.x0 + l.x1 between 2 * r.x0 and 2 * r.x1 and l.y0 + l.y1 between 2 * r.y0 and 2 * r.y1")
def centres_in_boxes(spark, sf_dir):
    """P5"""
    lines, regions = both(spark, sf_dir)
    r = regions.select("page_id", "region_id", *(F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")))
    return lines.join(r, "page_id").where(g.centre_inside(g.box(), g.box("b_"))).select("page_id", "line_id", "region_id")


@query(sql("quads") + """, d as (select page_id, line_id, sqrt((qx0 - qx1) * (qx0 - qx1) + (qy0 - qy1) * (qy0 - qy1)) as w, sqrt((qx0 - qx3) * (qx0 - qx3) + (qy0 - qy3) * (qy0 - qy3)) as h from quads)
 select page_id, line_id, cast(greatest(1, least(3200, ceil(case when least(w, h) > 0 then case when h >= w * 1.5 then h / w else w / h end * 48 else 0 end))) as int) as width, true as maps from d""")
def crop_transforms(spark, sf_dir):
    """Widths of crops, and transforms that take their corners to the line's"""
    return detection.with_transform(view(spark, sf_dir, "quads")).select("page_id", "line_id", "width", detection.maps_corners().alias("maps"))


# ---- decoding -----------------------------------------------------------------------------------------------------------------------------------


@query(_STEPS + ", a as (select seq_id, list(symbol order by step) as s, list(score order by step) as p from am group by seq_id), c as (select seq_id, s, p, coalesce(list_position(s[2:], 7), 8) as stop from a), k as (select seq_id, unnest(s[1:stop]) as x, unnest(p[1:stop]) as v from c) select seq_id, round(coalesce(avg(cast(v as double)) filter (where x <> 0 and x <> 7), 0), 6) as score from k group by seq_id")
def structure_scores(spark, sf_dir):
    """Mean scores of the tokens of a table's structure"""
    s = steps(spark, sf_dir).select("seq_id", F.struct("step", sequence.argmax(F.col("row")).alias("symbol"), F.array_max("row").alias("score")).alias("e")).groupBy("seq_id").agg(F.array_sort(F.collect_list("e")).alias("a"))
    score = sequence.structure_score(F.transform("a", lambda e: e["symbol"]), F.transform("a", lambda e: e["score"]), 0, 7)
    return s.select("seq_id", F.round(score, 6).alias("score"))


@query(r"""select p_partkey as seq_id, trim(case p_partkey % 4 when 0 then ' ' || p_brand || ' é' || p_type when 1 then p_brand || ' 漢' else '\frac' || p_brand || case when p_partkey % 4 = 3 then chr(65533) || 'x' else '' end end) as text from part""")
def formula_texts(spark, sf_dir):
    """Ids of byte-level tokens to text, with malformed bytes, specials, unknown ids and what follows the stop"""
    p = view(spark, sf_dir, "part")
    key = F.col("p_partkey")
    own = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("Ġ"))
    token = F.when(key % 4 == 0, F.concat(F.lit("Ġ"), own("p_brand"), F.lit("ĠÃ©"), own("p_type"))).when(key % 4 == 1, F.concat(F.lit("[BOS]"), own("p_brand"), F.lit("Ġæ¼¢[EOS]"))).otherwise(F.concat(F.lit("\\frac"), own("p_brand"), F.when(key % 4 == 3, "Ãx").otherwise("")))
    vocabulary = p.select((key + 10).alias("id"), token.alias("token")).unionByName(spark.createDataFrame([(0, "<s>"), (1, "</s>"), (2, "<pad>")], "id long, token string"))
    ids = p.select(key.alias("seq_id"), F.array(F.lit(0).cast("long"), key + 10, F.lit(2).cast("long"), F.lit(-5).cast("long"), F.lit(1).cast("long"), key + 10).alias("ids"))
    return sequence.token_texts(ids, vocabulary, 1, (0, 2))


@query("select doc_id, md5(text || chr(65533) || 'a' || chr(65533) || chr(65533) || 'é' || chr(65533) || text) as repaired, md5(text || chr(65533) || 'b' || chr(128512) || chr(65533)) as wide from documents")
def repaired_texts(spark, sf_dir):
    """Bytes that aren't UTF-8, and UTF-16 with halves of pairs"""
    raw = lambda h: F.unhex(F.lit(h))
    text = F.col("text").cast("binary")
    joined = F.concat(text, raw("FF61E282C3A9C3"), text)
    wide = F.concat(F.encode("text", "UTF-16LE"), raw("3DD86200"), raw("3DD800DE"), raw("00DE"), raw("00000000"))
    return view(spark, sf_dir, "documents").select("doc_id", F.md5(t.repaired_utf8(joined)).alias("repaired"), F.md5(t.utf16_text(wide)).alias("wide"))


_FORMULAS = r"""case p_partkey % 12 when 0 then '\frac{a}{b}' when 1 then '{' || p_brand when 2 then '\left( x \right)' when 3 then '\left\mathrm x' when 4 then 'x^2^3' when 5 then '\? x' when 6 then 'x_{1}^{2}' when 7 then '\begin{a}' when 8 then 'x_' when 9 then '\big -' when 10 then '\=a \{' else 'x\' end"""


@query("select p_partkey, p_partkey % 12 in (0, 2, 6, 10) as safe from part")
def safe_formulas(spark, sf_dir):
    """Formulas that a typesetter takes"""
    return latex.with_render_safe(view(spark, sf_dir, "part").select("p_partkey", F.expr(_FORMULAS.replace("\\", "\\\\")).alias("latex")), "latex").select("p_partkey", "safe")


# ---- envelopes and Markdown ---------------------------------------------------------------------------------------------------------------------


_PDF_PAGES = "select o_orderkey DIV 6 as doc_id, cast(o_orderkey % 6 as int) as page_index, case when o_custkey % 4 = 0 then 72 else 100 end as dpi, cast(600 + o_custkey % 7 as int) as width, cast(800 + o_custkey % 5 as int) as height, o_orderkey as id, case o_custkey % 3 when 0 then 'ocr' else 'geometric' end as mode, case when o_custkey % 3 = 0 then 'absent' else 'trusted' end as text_layer_quality, cast(o_custkey % 4 * 90 as int) as orientation_deg, o_custkey % 5 = 0 as drawn from {orders}"


@query("with p as (" + _PDF_PAGES.replace("DIV", "//").format(orders="orders") + """) select doc_id, '{"pages":[' || string_agg('{"page":' || (page_index + 1) || ',"page_index":' || page_index || ',"dpi":' || dpi || ',"width":' || width || ',"height":' || height || ',"results":[' || case when id % 2 = 0 then '{"id":' || id || ',"text":"line ' || id || '"}' else '' end
 || '],"mode":"' || mode || '","text_layer_quality":"' || text_layer_quality || '","orientation_deg":' || orientation_deg || case when drawn then ',"image_b64":"' || base64(encode('page ' || id)) || '","image_content_type":"image/png"' else '' end || '}', ',' order by page_index) || ']}' as json from p group by doc_id""")
def pdf_envelopes(spark, sf_dir):
    """K5"""
    p = spark.sql(_PDF_PAGES.replace("DIV", "div"), orders=view(spark, sf_dir, "orders"))
    line = F.struct("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    made = p.withColumns({"results": F.when(F.col("id") % 2 == 0, F.array(line)), "image": F.when(F.col("drawn"), F.concat(F.lit("page "), F.col("id").cast("string")).cast("binary")), "image_content_type": F.lit("image/png")})
    return render.pdf_json(made)


_TAGS = "select page_id, line_id as id, case when line_id % 11 = 0 then ' ' else text end as text, case when line_id % 7 = 0 then null else region_id end as layout_id, case when page_id % 2 = 0 then line_id * 37 % 101 end as place, x0, y0, x1, y1 from {lines}"


@query(BASE + ", " + OWNED + ", " + dims.CLASSES_SQL + ", tagged as (select l.*, o.region_id from lines l join owner o using (page_id, line_id)), rs as (" + _TAGS.format(lines="tagged") + """), sd as (select *, trim(text) as said, x0 + x1 as cx, y0 + y1 as cy from rs where trim(text) <> ''),
nm as (select page_id, layout_id as id, string_agg(said, ' ' order by cy, cx, id) as named from sd where layout_id is not null group by page_id, layout_id),
ls as (select r.page_id, r.region_id as id, string_agg(said, ' ' order by cy, cx, s.id) as loose from regions r join sd s on s.page_id = r.page_id and s.layout_id is null and cx between 2 * r.x0 and 2 * r.x1 and cy between 2 * r.y0 and 2 * r.y1 group by r.page_id, r.region_id),
ft as (select page_id, layout_id as id, min(place) as first_ from rs where layout_id is not null group by page_id, layout_id),
bl as (select r.page_id, r.region_id as id, c.label, r.y0, r.x0, first_, coalesce(named, loose, '') as text, case when r.region_id % 2 = 0 then '<table><tr><td>' || r.region_id || '</td></tr></table>' end as html, case when r.region_id % 3 <> 0 then 'x_' || r.region_id end as latex
 from regions r join classes c on c.class_id = r.class_id left join nm on nm.page_id = r.page_id and nm.id = r.region_id left join ls on ls.page_id = r.page_id and ls.id = r.region_id left join ft on ft.page_id = r.page_id and ft.id = r.region_id where c.label not in ('footer', 'footer_image', 'header', 'header_image', 'image', 'chart', 'seal')),
od as (select *, row_number() over (partition by page_id order by first_ nulls last, y0, x0, id) as turn, label in ('reference', 'reference_content') as cited from bl), hd as (select *, cited and sum(cast(cited as int)) over (partition by page_id order by turn) = 1 as heads from od),
pt as (select page_id, turn, case when label = 'table' then coalesce(html, '<table></table>') when label = 'display_formula' then '$$' || coalesce(latex, nullif(text, ''), ' ') || '$$' when label = 'inline_formula' then '$' || coalesce(latex, nullif(text, ''), ' ') || '$' when heads then '### References' || case when text <> '' then chr(10) || chr(10) || '- ' || text else '' end
 when text = '' then null when cited or label = 'content' then '- ' || text when label = 'algorithm' then '```algorithm' || chr(10) || text || chr(10) || '```' when label = 'doc_title' then '# ' || text when label = 'paragraph_title' then '## ' || text when label = 'figure_title' then '### ' || text when label = 'abstract' then '**Abstract** ' || text when label = 'aside_text' then '> ' || text else text end as part from hd),
pg as (select page_id from regions union select page_id from lines) select pg.page_id, coalesce(md, '') || chr(10) as markdown from pg left join (select page_id, string_agg(part, chr(10) || chr(10) order by turn) as md from pt where part is not null group by page_id) q on q.page_id = pg.page_id""")
def evaluation_markdown(spark, sf_dir):
    """M7: Markdown for scores"""
    lines, regions = both(spark, sf_dir)
    results = spark.sql(_TAGS, lines=layout.with_owner(lines, regions))
    boxes = dims.with_class(regions, "label").select("page_id", F.col("region_id").alias("id"), "label", "x0", "y0", "x1", "y1")
    key = F.col("region_id").cast("string")
    tables = regions.where("region_id % 2 = 0").select("page_id", F.col("region_id").alias("layout_id"), F.concat(F.lit(" <table><tr><td>"), key, F.lit("</td></tr></table> ")).alias("html"))
    formulas = regions.where("region_id % 3 <> 0").select("page_id", F.col("region_id").alias("layout_id"), F.concat(F.lit("x_"), key).alias("latex"))
    return render.evaluation_markdown(results, boxes, tables, formulas)


@query(_CHARS + """, n as (select *, sum(cast(ch in (chr(10), chr(13)) as int)) over (partition by doc_id order by idx) as line from ch), l as (select doc_id, line, rtrim(string_agg(ch, '' order by idx)) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from n where ch not in (chr(10), chr(13)) and (ascii(ch) >= 32 or ch = chr(9)) group by doc_id, line)
select doc_id, cast(line as bigint) as line, text, 1.0 as confidence, 'pdf' as source, cast(floor(x0 * 0.75 + 0.5) as int) as x0, cast(floor(y0 * 0.75 + 0.5) as int) as y0, cast(floor(x1 * 0.75 + 0.5) as int) as x1, cast(floor(y1 * 0.75 + 0.5) as int) as y1 from l where text <> ''""")
def text_layer_results(spark, sf_dir):
    """Results of pages from their text layers"""
    lines = pdf.lines_of(characters(spark, sf_dir)).withColumns({k: F.col(k) * 0.75 for k in ("x0", "y0", "x1", "y1")})
    return pdf.fill_from_layer(lines)


# ---- samples --------------------------------------------------------------------------------------------------------------------------------------


@query()
def stratified_sample(spark, sf_dir):
    """125 items that flatten the histogram of their strata"""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    items = view(spark, sf_dir, "orders").select(key.alias("id"), (key % 97 == 0).alias("has_table"), (key % 89 == 0).alias("has_formula"), (customer % 10 != 0).alias("has_text"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("language"), (customer % 4).alias("layout"))
    return sampling.flattened(items, ("source", "language", "layout"), 125)


@query("select event_type as route, event_id, value from (select *, row_number() over (partition by event_type order by value, event_id) as rn from events) t where rn <= 25")
def cheapest_items(spark, sf_dir):
    """The first 25 of each stratum"""
    return quality.first_of_each(view(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "event_id", "value"), "route", ("value", "event_id"), 25)


# ---- hooks and functions for SQL --------------------------------------------------------------------------------------------------------------------


@query(ORACLES["markdown_parts"].replace("'](block' || region_id || '.png)'", "'](https://images/' || page_id || '/' || region_id || ')'"))
def linked_images(spark, sf_dir):
    """Markdown whose images have addresses that a caller makes"""
    return parts(spark, sf_dir, lambda page, region: F.concat_ws("/", F.lit("https://images"), page.cast("string"), region.cast("string")))


@query(ORACLES["table_cells"])
def lateral_cells(spark, sf_dir):
    """Cells of tables by a table function in SQL"""
    tablefunctions.register(spark)
    return spark.sql("select p_partkey, c.* from {tables} t, lateral table_cells(t.html) c", tables=html_tables(spark, sf_dir))


@query("select p_partkey, 1 as row_, 1 as col, 'fcel' as kind, p_brand as text from part union all select p_partkey, 1, 2, 'lcel', '' from part union all select p_partkey, 2, 1, 'ecel', '' from part")
def lateral_tokens(spark, sf_dir):
    """Cells of structure tokens by a table function in SQL"""
    tablefunctions.register(spark)
    made = view(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<fcel>"), "p_brand", F.lit("<lcel><nl><ecel><nl>")).alias("tokens"))
    return spark.sql("select p_partkey, c.* from {tables} t, lateral token_cells(t.tokens) c", tables=made)
