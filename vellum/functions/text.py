"""Text functions as columns: what they take and give is a column, so none leaves generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of headings at level 1, normalised as by keyword_key.
KEYWORDS = (
    "ABSTRACT", "SUMMARY", "RESUME", "绪论", "引言", "CONTENTS", "REFERENCES", "REFERENCE", "参考文献", "APPENDIX", "APPENDICES", "附录", "ACKNOWLEDGMENTS",
    "INTRODUCTION", "BACKGROUNDANDRELATEDWORK", "BACKGROUND", "RELATEDWORK", "THEORETICALMODELS", "DATA", "METHOD", "METHODS", "METHODOLOGY", "TOPICANALYSIS",
    "RESULT", "RESULTS", "DISCUSSION", "CONCLUSIONS", "CONCLUSION", "LIMITATIONS", "研究背景", "相关工作", "研究方法", "实验结果", "讨论", "结论", "致谢", "目录",
)
#: Tags and attributes that tables may keep.
TABLE_TAGS = ("table", "thead", "tbody", "tr", "td", "th", "col", "colgroup", "caption", "b", "i", "strong", "em")
SPAN_ATTRIBUTES = ("colspan", "rowspan", "align", "valign")
SPACE = r"[ \t\n\x0B\f\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDE = "".join(chr(0xFF01 + i) for i in range(94))
NARROW = "".join(chr(0x21 + i) for i in range(94))
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]"
CHINESE_NUMBER = "[一二三四五六七八九十零百千]"
#: Latin, Chinese and other forms of numbering, in the order in which they are tried; the level is a number or the dots plus one.
NUMBERING = (
    ("NUM_LIST_BRACKET", rf"^{SPACE}*[(（]?[0-9]+(?:\.[0-9]+)*[)）]", 4),
    ("ROMAN", rf"^{SPACE}*[IVXivx]+(?:$|[.)．]|{SPACE})", 1),
    ("CHINESE_NUM", rf"^{SPACE}*(?:第|[(（])?{CHINESE_NUMBER}{{1,2}}(?:$|[^A-Za-z一-龥]|[章节部分篇])", 1),
    ("LETTER", rf"^{SPACE}*[A-Za-z](?:[.)．]|{SPACE})", 2),
    ("NUM_LIST", rf"^{SPACE}*[0-9]+(?:\.[0-9]+)*(?:$|[^0-9)）])", None),
)


def trim(text: Column) -> Column:
    """Takes ASCII white space off both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def ascii_lower(text: Column) -> Column:
    """X3"""
    return F.translate(text, UPPER, LOWER)


def half_width(text: Column) -> Column:
    """Full-width forms of ASCII become ASCII."""
    return F.translate(text, WIDE, NARROW)


def normal_text(text: Column) -> Column:
    """Half width, without white space."""
    return F.regexp_replace(half_width(text), f"{SPACE}+", "")


def cjk_count(text: Column) -> Column:
    """X8"""
    return F.regexp_count(text, F.lit(CJK))


def contains_cjk(text: Column) -> Column:
    """X9"""
    return text.rlike(r"[\x{4E00}-\x{9FFF}]")


def replacement_count(text: Column) -> Column:
    """Replacement characters."""
    return F.regexp_count(text, F.lit("�"))


def unprintable_count(text: Column) -> Column:
    """Control characters but for tab, line feed and carriage return."""
    return F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))


def tokens(text: Column) -> Column:
    """X11: runs of letters a to z and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0)


def numbering(text: Column) -> tuple[Column, Column]:
    """(kind, level) of a heading's number; null where it has none."""
    kind, level = F.lit(None).cast("string"), F.lit(None).cast("int")
    clean = trim(text)
    for name, pattern, depth in reversed(NUMBERING):
        hit = clean.rlike(pattern)
        dots = F.length(F.regexp_replace(F.regexp_extract(clean, r"^[0-9]+(?:\.[0-9]+)*", 0), "[^.]", "")) + 1
        kind = F.when(hit, name).otherwise(kind)
        level = F.when(hit, F.lit(depth) if depth else dots).otherwise(level)
    return kind, level.cast("int")


def keyword_key(text: Column) -> Column:
    """Upper case, without ends, closing colons and spaces."""
    return F.replace(F.regexp_replace(trim(F.translate(text, LOWER, UPPER)), "[:： ]+$", ""), F.lit(" "), F.lit(""))


def is_keyword(text: Column) -> Column:
    return keyword_key(text).isin(*KEYWORDS)


def link_escape(text: Column) -> Column:
    """For the text of Markdown links; runs of line ends become one space."""
    return F.regexp_replace(F.regexp_replace(text, r"([\[\]()\\])", r"\\$1"), r"[\r\n]+", " ")


def code_span(text: Column) -> Column:
    """X19"""
    return F.when(F.contains(text, F.lit("`")), F.concat(F.lit("`` "), text, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), text, F.lit("`")))


def clean_tag(text: Column) -> Column:
    """Trims, and takes off one pair of parentheses."""
    clean = trim(text)
    return F.when(clean.rlike(r"^\([\s\S]*\)$"), trim(F.substring(clean, F.lit(2), F.length(clean) - 2))).otherwise(clean)


def html_escape(text: Column) -> Column:
    """Five entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cell_escape(text: Column) -> Column:
    """Three entities; bold marks stay."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("&lt;b&gt;", "<b>"), ("&lt;/b&gt;", "</b>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_tags(html: Column) -> Column:
    """No tag and no stray end of one."""
    return F.replace(F.regexp_replace(html, "<[^>]*>?", ""), F.lit(">"), F.lit(""))


def span(tag: Column, name: str) -> Column:
    """A span attribute of an opening tag, between 1 and 512."""
    digits = F.regexp_extract(tag, rf"[<\s\"']{name}[ =\"']*([0-9]+)", 1)
    value = F.when(F.length(digits) > 4, 512).otherwise(F.try_to_number(digits, F.lit("9999")).cast("int"))
    return F.when(digits == "", 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(512), value)))


def rows_of(html: Column) -> Column:
    """The table rows."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr.*?</tr>"), 0)


def cells_of(row: Column) -> Column:
    """The cells of a row, opening tags and all."""
    return F.regexp_extract_all(row, F.lit(r"(?is)<t[dh].*?</t[dh]>"), 0)


def sanitize(html: Column) -> Column:
    """No scripts or styles; tags of tables and emphasis, rebuilt from their names and from letters and digits of their spans and alignment; other tags go, their text stays."""
    html = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?(</\1[^>]*>|$)", "")

    def value(tag: Column, name: str) -> Column:
        pattern = rf"(?i)[\s\"']{name}=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))"
        given = F.regexp_replace(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3))), "[^A-Za-z0-9]", "")
        return F.when(given == "", "").otherwise(F.concat(F.lit(f' {name}="'), given, F.lit('"')))

    def part(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([^ \t\r\n>]*)", 1))
        opening = F.concat(F.lit("<"), name, *(value(token, x) for x in SPAN_ATTRIBUTES), F.lit(">"))
        tag = F.when(~name.isin(*TABLE_TAGS), "").when(F.startswith(token, F.lit("</")), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(opening)
        return F.when(token == "<", "&lt;").when(F.startswith(token, F.lit("<")), tag).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(r"<[^>]*>|<|[^<]+"), 0), part), "")


def table_part(html: Column) -> Column:
    """From the first opening tag of a table to the last closing one."""
    return F.regexp_extract(html, r"(?is)(<table.*</table>)", 1)


def cell_content(text: Column) -> Column:
    """Without one leading space and the marks of bold."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^ ", ""), "^<b>", ""), "</b>$", "")


def latex_of(reply: Column) -> Column:
    """The formula in a model's reply: a fence, display marks, brackets, inline marks, or the reply without its label."""
    out = trim(F.regexp_replace(trim(reply), "^(?:LaTeX:|Latex:|latex:|Answer:|answer:)", ""))
    for pattern, tail in ((r"\$([^$\n]+)\$", False), (r"\\\[([\s\S]*?)\\\]", False), (r"\$\$([\s\S]*?)\$\$", False), (r"```(?:latex|tex|math)?\s*\n?([\s\S]*?)```", True)):
        found = F.regexp_extract(reply, pattern, 1)
        out = F.when(reply.rlike(pattern), F.regexp_replace(found, r"[\n\r ]+$", "") if tail else found).otherwise(out)
    return out


def frame_stripped(text: Column) -> Column:
    """Marks of a decoder's frame."""
    return trim(F.regexp_replace(text, r"\[(?:BOS|EOS|PAD)\]", ""))


def scripts(text: Column, known: tuple[str, ...]) -> Column:
    """Known names in a list parted by commas, in order and once; null if one isn't known."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.lower(trim(x))), lambda x: x != "")
    return F.when(F.forall(parts, lambda x: x.isin(*known)), F.array_distinct(parts))


def decode_base64(text: Column) -> Column:
    """S3: bytes of base64 text without padding and line ends at its tail; empty on an error."""
    body = F.regexp_replace(text, r"[=\r\n]+$", "")
    return F.coalesce(F.try_to_binary(F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")), F.lit(b""))


def encode_base64(data: Column) -> Column:
    """On one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def score_text(score: Column) -> Column:
    """K2: five significant digits, no closing zeros; 0 for what is no number."""
    digits = F.when(score == 0, 0).otherwise(F.floor(F.log10(F.abs(score))))
    scale = F.pow(F.lit(10.0), F.lit(4) - digits)
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).when(score == 0, 0.0).otherwise(F.round(score * scale) / scale)


def runaway_line(text: Column, least: int = 10) -> Column:
    """The line that makes up four fifths of the text's lines, if there are ten of it; else the text."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")
    best = F.aggregate(F.array_distinct(lines), F.struct(F.lit(0).alias("n"), F.lit("").alias("x")), lambda acc, x: F.when(F.size(F.filter(lines, lambda y: y == x)) > acc["n"], F.struct(F.size(F.filter(lines, lambda y: y == x)).alias("n"), x.alias("x"))).otherwise(acc))
    return F.when((F.octet_length(text) >= 3000) & (best["n"] >= least) & (best["n"] * 10 >= F.size(lines) * 8), best["x"]).otherwise(text)


#: Bytes, as characters of Latin-1, that no sequence of a lead byte and its continuation bytes holds. A lead byte is never part of another sequence, so what
#: stands a few bytes before and after tells.
_C = r"[\x80-\xBF]"
_HELD = rf"(?<=[\xC0-\xDF])|(?<=[\xE0-\xEF])(?=.{_C})|(?<=[\xE0-\xEF]{_C})|(?<=[\xF0-\xF7])(?=.{_C}{_C})|(?<=[\xF0-\xF7]{_C})(?=.{_C})|(?<=[\xF0-\xF7]{_C}{_C})"
BAD_BYTES = rf"(?s)[\xC0-\xDF](?!{_C})|[\xE0-\xEF](?!{_C}{{2}})|[\xF0-\xF7](?!{_C}{{3}})|[\xF8-\xFF]|(?!{_HELD}){_C}"


def repaired_utf8(binary: Column) -> Column:
    """Bytes as text, with U+FFFD for each byte that stands in no sequence of a lead byte and as many continuation bytes as it asks for."""
    return F.encode(F.regexp_replace(F.decode(binary, "ISO-8859-1"), BAD_BYTES, "\xef\xbf\xbd"), "ISO-8859-1").cast("string")


def utf16_text(binary: Column) -> Column:
    """Little-endian UTF-16 as text: zeros at the end go, halves of pairs that stand alone become U+FFFD, an odd last byte is ignored."""
    units = F.regexp_replace(F.substring(F.hex(binary), F.lit(1), F.expr("0") + F.floor(F.octet_length(binary) / 2).cast("int") * 4), "(..)(..)", "$2$1 ")
    units = F.regexp_replace(units, "(?:0000 )+$", "")
    alone = F.regexp_replace(F.regexp_replace(units, "D[89AB].. (?!D[CDEF])", "FFFD "), "(?<!D[89AB].. )D[CDEF].. ", "FFFD ")
    return F.decode(F.unhex(F.replace(alone, F.lit(" "), F.lit(""))), "UTF-16BE")
