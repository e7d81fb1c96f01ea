"""Queries over texts, markup and model replies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.plans.registry import query
from vellum.sources.views import view

#: What the test texts lack is put in: wide forms, CJK, controls, numbers of headings.
_INJECT = {
    0: ("concat('1 ', {})", "1 "), 1: ("", "1.2 "), 2: ("", "(3) "), 3: ("", "IV. "), 4: ("", "A. "), 5: ("", "第一章 "), 6: ("", "Ａ１（x）"), 7: ("", "漢字\u0001� "),
}
_PREFIX = "case doc_id % 8 " + " ".join(f"when {k} then '{v[1]}'" for k, v in _INJECT.items()) + " end"
_HEADS = f"with heads as (select doc_id, concat({_PREFIX}, coalesce(nullif(split_part(text, chr(10), 1), ''), 'x')) as head, text from documents)"
_S = r"[ \t\n\x0B\f\r]"


def heads(spark, sf_dir):
    """First lines of documents behind a number or characters that the texts lack."""
    d = view(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.expr(_PREFIX), F.coalesce(F.nullif(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")), F.lit("x"))).alias("head"), "text")


_WHOLE = f"with heads as (select doc_id, concat({_PREFIX}, coalesce(nullif(text, ''), 'x')) as head, text from documents)"


def whole_heads(spark, sf_dir):
    """Whole texts behind the same prefixes."""
    d = view(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.expr(_PREFIX), F.coalesce(F.nullif("text", F.lit("")), F.lit("x"))).alias("head"))


def _hashed(columns: str, kept: str, text: str) -> str:
    """SQL with hashes in place of its long columns."""
    return f"select {kept}, " + ", ".join(f"sha256({c}) as {c}" for c in columns.split()) + f" from ({text}) q"


def _hash(frame, columns: str):
    return frame.withColumns({c: F.sha2(c, 256) for c in columns.split()})


@query(_hashed("trimmed lower half normal", "doc_id, points", _WHOLE + rf""" select doc_id, regexp_replace(regexp_replace(concat(chr(9), ' ', head, chr(11), chr(10)), '^{_S}+', ''), '{_S}+$', '') as trimmed, cast(length(head) as int) as points,
 translate(head, '{t.UPPER}', '{t.LOWER}') as lower, translate(head, '{t.WIDE}', '{t.NARROW.replace("'", "''")}') as half, regexp_replace(translate(head, '{t.WIDE}', '{t.NARROW.replace("'", "''")}'), '{_S}+', '', 'g') as normal from heads"""))
def text_normal_forms(spark, sf_dir):
    """X1, X2, X3, X6, X7"""
    h, c = whole_heads(spark, sf_dir), F.col("head")
    out = h.select("doc_id", t.trim(F.concat(F.lit("\t "), c, F.lit("\x0b\n"))).alias("trimmed"), F.char_length(c).alias("points"), t.ascii_lower(c).alias("lower"), t.half_width(c).alias("half"), t.normal_text(c).alias("normal"))
    return _hash(out, "trimmed lower half normal")


@query(_WHOLE + r""" select doc_id, cast(length(regexp_replace(head, '[^\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]', '', 'g')) as int) as cjk, regexp_matches(head, '[\x{4E00}-\x{9FFF}]') as has_cjk,
 cast(length(regexp_replace(head, '[^\x{FFFD}]', '', 'g')) as int) as replaced, cast(length(regexp_replace(head, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) as int) as controls from heads""")
def character_counts(spark, sf_dir):
    """X8, X9, X10"""
    c = F.col("head")
    return whole_heads(spark, sf_dir).select("doc_id", t.cjk_count(c).alias("cjk"), t.contains_cjk(c).alias("has_cjk"), t.replacement_count(c).alias("replaced"), t.unprintable_count(c).alias("controls"))


@query(_WHOLE + ", n as (select doc_id % 100 as page, sum(length(regexp_replace(head, '[^\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FFFF}]', '', 'g'))) as cjk, sum(length(head)) as total from heads group by 1) select page, cast(cjk as bigint) as cjk, cast(total as bigint) as total, cjk >= 3 and cjk * 100 >= total as is_cjk from n")
def cjk_pages(spark, sf_dir):
    """A12"""
    n = whole_heads(spark, sf_dir).groupBy((F.col("doc_id") % 100).alias("page")).agg(F.sum(t.cjk_count(F.col("head"))).alias("cjk"), F.sum(F.char_length("head")).alias("total"))
    return n.withColumn("is_cjk", (F.col("cjk") >= 3) & (F.col("cjk") * 100 >= F.col("total")))


def _level_sql() -> str:
    from vellum.functions.text import NUMBERING

    kind = " ".join(f"when regexp_matches(c, '{p}') then '{name}'" for name, p, _ in NUMBERING)
    level = " ".join(f"when regexp_matches(c, '{p}') then {d or 'length(regexp_replace(regexp_extract(c, $$^[0-9]+(?:[.][0-9]+)*$$), $$[^.]$$, $$$$, $$g$$)) + 1'}" for _, p, d in NUMBERING)
    return rf", u as (select doc_id, regexp_replace(regexp_replace(head, '^{_S}+', ''), '{_S}+$', '') as c from heads) select doc_id, case {kind} end as kind, cast(case {level} end as int) as level from u"


@query(_HEADS + _level_sql())
def heading_numbers(spark, sf_dir):
    """X13"""
    kind, level = t.numbering(F.col("head"))
    return heads(spark, sf_dir).select("doc_id", kind.alias("kind"), level.alias("level"))


_KEYS = "case doc_id % 5 when 0 then ' References: ' when 1 then 'Related Work' when 2 then '引言：' when 3 then 'method s' else split_part(text, ' ', 1) end"


@query(f"with k as (select doc_id, {_KEYS} as head from documents) select doc_id, replace(regexp_replace(regexp_replace(regexp_replace(translate(head, '{t.LOWER}', '{t.UPPER}'), '^{_S}+', ''), '{_S}+$', ''), '[:： ]+$', ''), ' ', '') as key, " + f"replace(regexp_replace(regexp_replace(regexp_replace(translate(head, '{t.LOWER}', '{t.UPPER}'), '^{_S}+', ''), '{_S}+$', ''), '[:： ]+$', ''), ' ', '') in ({', '.join(repr(x) for x in t.KEYWORDS)}) as is_keyword from k")
def heading_keywords(spark, sf_dir):
    """X14"""
    k = view(spark, sf_dir, "documents").select("doc_id", F.expr(_KEYS).alias("head"))
    return k.select("doc_id", t.keyword_key(F.col("head")).alias("key"), t.is_keyword(F.col("head")).alias("is_keyword"))


@query(_hashed("link code tag", "doc_id", r"""with s as (select doc_id, concat('[', text, '](a\b)') as a, case when doc_id % 2 = 0 then concat('( ', text, ' )') else text end as b from documents)
select doc_id, regexp_replace(regexp_replace(a, '([\[\]()\\])', '\\\1', 'g'), '[\r\n]+', ' ', 'g') as link, case when contains(a, '`') then '`` ' || a || ' ``' else '`' || a || '`' end as code,
 case when regexp_matches(regexp_replace(regexp_replace(b, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''), '^\([\s\S]*\)$') then regexp_replace(regexp_replace(substr(b, 2, length(b) - 2), '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '')
 else regexp_replace(regexp_replace(b, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '') end as tag from s"""))
def markdown_escapes(spark, sf_dir):
    """X18, X19, X20"""
    text = F.col("text")
    a, b = F.concat(F.lit("["), text, F.lit("](a\\b)")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("( "), text, F.lit(" )"))).otherwise(text)
    return _hash(view(spark, sf_dir, "documents").select("doc_id", t.link_escape(a).alias("link"), t.code_span(a).alias("code"), t.clean_tag(b).alias("tag")), "link code tag")


_E5 = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_E3 = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;b&gt;', '<b>'), '&lt;/b&gt;', '</b>')"


@query(_hashed("content", "page_id, escaped, cell, bare", f"select page_id, sha256({_E5.format('html')}) as escaped, sha256({_E3.format('html')}) as cell, sha256(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', '')) as bare, regexp_replace(regexp_replace(regexp_replace(html, '^ ', ''), '^<b>', ''), '</b>$', '') as content from pages"))
def html_escapes(spark, sf_dir):
    """X21, X22, X27"""
    h = F.col("html")
    return _hash(view(spark, sf_dir, "pages").select("page_id", *(f(h).alias(k) for k, f in (("escaped", t.html_escape), ("cell", t.cell_escape), ("bare", t.strip_tags), ("content", t.cell_content)))), "escaped cell bare content")


#: A table for each part: spans, cells and a stray script.
_TABLE = """concat('<p>x</p><TABLE id="t"><tr><td colspan="', cast(p_size % 5 as varchar(9)), '">', p_brand, '</td><td>', p_type, '</td></tr><TR><th rowspan=2 style="a:b">', p_name, '</th><td><a href="u">', cast(p_size as varchar(9)), '</a></td></TR></table><script>x<y</script> 1 < 2')"""


def html_tables(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", F.expr(_TABLE).alias("html"))


_CELLS = f"""with tab as (select p_partkey, {_TABLE} as html from part), r as (select p_partkey, unnest(regexp_extract_all(html, '(?is)<tr.*?</tr>')) as tr, generate_subscripts(regexp_extract_all(html, '(?is)<tr.*?</tr>'), 1) as row_ from tab),
c as (select p_partkey, row_, unnest(regexp_extract_all(tr, '(?is)<t[dh].*?</t[dh]>')) as cell, generate_subscripts(regexp_extract_all(tr, '(?is)<t[dh].*?</t[dh]>'), 1) as col from r),
s as (select p_partkey, row_, col, replace(regexp_replace(cell, '<[^>]*>?', '', 'g'), '>', '') as text, regexp_extract(split_part(cell, '>', 1), '[<\\s"'']colspan[ ="'']*([0-9]+)', 1) as cs, regexp_extract(split_part(cell, '>', 1), '[<\\s"'']rowspan[ ="'']*([0-9]+)', 1) as rs from c),
cells as (select p_partkey, cast(row_ as int) as row_, cast(col as int) as col, text, cast(case when cs = '' then 1 else greatest(1, least(512, cast(cs as int))) end as int) as colspan, cast(case when rs = '' then 1 else greatest(1, least(512, cast(rs as int))) end as int) as rowspan from s)"""


def table_cells_of(frame):
    """A row for each cell of each table."""
    rows = frame.select("p_partkey", F.posexplode(t.rows_of(F.col("html"))).alias("r", "tr"))
    cells = rows.select("p_partkey", (F.col("r") + 1).alias("row_"), F.posexplode(t.cells_of(F.col("tr"))).alias("c", "cell"))
    head = F.split_part("cell", F.lit(">"), F.lit(1))
    return cells.select("p_partkey", "row_", (F.col("c") + 1).alias("col"), t.strip_tags(F.col("cell")).alias("text"), t.span(head, "colspan").alias("colspan"), t.span(head, "rowspan").alias("rowspan"))


@query(_CELLS + " select * from cells")
def table_cells(spark, sf_dir):
    """X22, X23, X24"""
    return table_cells_of(html_tables(spark, sf_dir))


@query(_CELLS + " select p_partkey, row_, cast(sum(colspan) as bigint) as columns, count(*) as cells from cells group by p_partkey, row_")
def table_row_widths(spark, sf_dir):
    """A24"""
    return table_cells_of(html_tables(spark, sf_dir)).groupBy("p_partkey", "row_").agg(F.sum("colspan").alias("columns"), F.count("*").alias("cells"))


@query(f"""with tab as (select p_partkey, {_TABLE} as html from part) select p_partkey, '<table><tr><td colspan="' || cast(p_size % 5 as varchar) || '">' || p_brand || '</td><td>' || p_type || '</td></tr><tr><th rowspan="2">' || p_name || '</th><td>' || cast(p_size as varchar) || '</td></tr></table> 1 &lt; 2' as clean_tail,
 regexp_extract(html, '(?is)(<table.*</table>)', 1) as part from tab join part using (p_partkey)""")
def table_sanitised(spark, sf_dir):
    """X25, X26"""
    h = F.col("html")
    return html_tables(spark, sf_dir).select("p_partkey", F.regexp_replace(t.sanitize(h), "^x", "").alias("clean_tail"), t.table_part(h).alias("part"))


_REPLY = r"""case doc_id % 9 when 0 then concat('text ```latex', chr(10), w, ' ', chr(10), '``` end') when 1 then concat('a $$', w, '$$ b') when 2 then concat('\[', w, '\]') when 3 then concat('x $', w, '$ y') when 4 then concat('LaTeX: ', w) when 5 then concat('Answer:  ', w, ' ') when 6 then concat('```', w, '```') when 7 then '' else concat('  ', w, chr(10)) end"""


@query(_hashed("latex", "doc_id", rf"""with w as (select doc_id, text as w from documents), r as (select doc_id, {_REPLY} as reply from w)
select doc_id, case when regexp_matches(reply, '```(?:latex|tex|math)?\s*\n?([\s\S]*?)```') then regexp_replace(regexp_extract(reply, '```(?:latex|tex|math)?\s*\n?([\s\S]*?)```', 1), '[\n\r ]+$', '')
 when regexp_matches(reply, '\$\$([\s\S]*?)\$\$') then regexp_extract(reply, '\$\$([\s\S]*?)\$\$', 1) when regexp_matches(reply, '\\\[([\s\S]*?)\\\]') then regexp_extract(reply, '\\\[([\s\S]*?)\\\]', 1)
 when regexp_matches(reply, '\$([^$\n]+)\$') then regexp_extract(reply, '\$([^$\n]+)\$', 1)
 else regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(reply, '^{_S}+', ''), '{_S}+$', ''), '^(?:LaTeX:|Latex:|latex:|Answer:|answer:)', ''), '^{_S}+', ''), '{_S}+$', '') end as latex from r"""))
def latex_replies(spark, sf_dir):
    """X30, X31"""
    w = view(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("w"))
    return _hash(w.select("doc_id", t.latex_of(F.expr(_REPLY.replace("\\", "\\\\"))).alias("latex")), "latex")


@query(_hashed("bare", "doc_id, scripts", f"""select doc_id, regexp_replace(regexp_replace(regexp_replace('[BOS] ' || text || ' [EOS][PAD]', '\\[(?:BOS|EOS|PAD)\\]', '', 'g'), '^{_S}+', ''), '{_S}+$', '') as bare,
 case when doc_id % 3 = 2 then null when doc_id % 3 = 1 then 'latin' else 'latin,greek' end as scripts from documents"""))
def decoder_text(spark, sf_dir):
    """X34, X35"""
    bare = t.frame_stripped(F.concat(F.lit("[BOS] "), F.col("text"), F.lit(" [EOS][PAD]")))
    lists = F.when(F.col("doc_id") % 3 == 2, "latin, klingon").when(F.col("doc_id") % 3 == 1, "Latin").otherwise(" latin,GREEK,latin,")
    return view(spark, sf_dir, "documents").select("doc_id", F.sha2(bare, 256).alias("bare"), F.array_join(t.scripts(lists, ("latin", "greek", "cyrillic")), ",").alias("scripts"))


@query("select doc_id, base64(encode(text)) as b64, md5(text) as back, '' as broken from documents")
def base64_round_trip(spark, sf_dir):
    """S2, S3, S4"""
    b = t.encode_base64(F.col("text").cast("binary"))
    return view(spark, sf_dir, "documents").select("doc_id", b.alias("b64"), F.md5(t.decode_base64(F.concat(b, F.lit("\r\n")))).alias("back"), t.decode_base64(F.lit("*!")).cast("string").alias("broken"))


@query("""select event_id, case when value = 0 then 0.0 else round(value * pow(10.0, 4 - floor(log10(abs(value))))) / pow(10.0, 4 - floor(log10(abs(value)))) end as shown from events""")
def score_format(spark, sf_dir):
    """K2"""
    return view(spark, sf_dir, "events").select("event_id", t.score_text(F.col("value")).alias("shown"))


@query(rf"""with l as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x : regexp_replace(regexp_replace(x, '^{_S}+', ''), '{_S}+$', '')), lambda x : x <> '') as a from documents),
u as (select doc_id, unnest(a) as x, generate_subscripts(a, 1) as i from l), c as (select doc_id, x, count(*) as n, min(i) as i from u group by doc_id, x), b as (select doc_id, n, x from (select *, row_number() over (partition by doc_id order by n desc, i) as rn from c) t where rn = 1)
select l.doc_id, md5(case when octet_length(encode(text)) >= 3000 and n >= 10 and n * 10 >= len(a) * 8 then x else text end) as kept from l left join b using (doc_id)""")
def runaway_lines(spark, sf_dir):
    """G19 (lines), A20"""
    return view(spark, sf_dir, "documents").select("doc_id", F.md5(t.runaway_line(F.col("text"))).alias("kept"))


@query("""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as a from documents), g as (select doc_id, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] || ' ' || a[i + 3] || ' ' || a[i + 4] as g from (select doc_id, a, unnest(range(1, greatest(len(a) - 3, 1))) as i from w where len(a) >= 5) t),
c as (select doc_id, max(n) as most from (select doc_id, g, count(*) as n from g group by doc_id, g) t group by doc_id) select doc_id, cast(coalesce(most, 0) as bigint) as most from w left join c using (doc_id)""")
def repeated_windows(spark, sf_dir):
    """The count of the most frequent window of five words"""
    w = view(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("a"))
    at = F.transform(F.sequence(F.lit(1), F.size("a") - 4), lambda i: F.array_join(F.slice("a", i, 5), " "))
    grams = w.where(F.size("a") >= 5).select("doc_id", F.explode(at).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("most"))
    return w.select("doc_id").join(grams, "doc_id", "left").select("doc_id", F.coalesce("most", F.lit(0)).cast("long").alias("most"))


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as a from documents), g as (select doc_id, count(*) as n, count(distinct a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) as d from (select doc_id, a, unnest(range(1, len(a) - 1)) as i from w where len(a) >= 50) t group by doc_id) select doc_id, n, d, d * 4 < n as collapsed from g")
def trigram_uniqueness(spark, sf_dir):
    """A22, U5"""
    w = view(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("a")).where(F.size("a") >= 50)
    grams = F.transform(F.sequence(F.lit(1), F.size("a") - 2), lambda i: F.array_join(F.slice("a", i, 3), " "))
    return w.select("doc_id", (F.size("a") - 2).cast("long").alias("n"), F.size(F.array_distinct(grams)).cast("long").alias("d")).withColumn("collapsed", F.col("d") * 4 < F.col("n"))
