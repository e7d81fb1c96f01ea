"""Columns of pages, LaTeX clean-up, backends and detector geometry on literal cases."""

import pytest

from vellum.functions import backends, latex
from vellum.operators import columns, detection


def test_columns(spark):
    left = [(20, y, 380, y + 80) for y in (100, 200, 300)]
    right = [(420, y, 780, y + 80) for y in (100, 200, 300)]
    woven = [b for pair in zip(left, right) for b in pair]
    pages = [woven, [(20, 10, 780, 60), *woven], [(20, y, 780, y + 80) for y in (100, 200, 300, 400)], left, [(20, y, 380, y + 80) for y in (100, 200)] + [(420, y, 780, y + 80) for y in (400, 500)]]
    rows = [(p, i, 22, *b, i) for p, page in enumerate(pages) for i, b in enumerate(page)]
    found: dict = {}
    for r in columns.column_major(spark.createDataFrame(rows, "page_id long, region_id int, class_id int, x0 int, y0 int, x1 int, y1 int, place int")).orderBy("place").collect():
        found.setdefault(r["page_id"], []).append(r["region_id"])
    assert found == {0: [0, 2, 4, 1, 3, 5], 1: [0, 1, 3, 5, 2, 4, 6], 2: [0, 1, 2, 3], 3: [0, 1, 2], 4: [0, 1, 2, 3]}


def test_latex():
    assert latex.tidy(r"\text {漢字} x") == "漢字x"
    assert latex.tidy('a "b" + c') == "a b+c"
    assert latex.tidy(r"\operatorname {a b} x") == r"\operatorname{ab}x"
    assert latex.tidy("x _ { 1 }") == "x_{1}" and latex.tidy("a b") == "a b" and latex.tidy("") == ""


def test_routing():
    routing = backends.Routing.parse('{"backends": {"a": {"kind": "local"}, "b": {"kind": "openai", "url": "u"}}, "routes": {"table": "a", "formula": "default"}}')
    assert routing.resolve("table").name == "a" and routing.resolve("formula") is None and routing.resolve("x", "b").name == "b"
    assert routing.routable("table") == {"a", "b"} and routing.routable("formula") == {"b"}
    for bad in ('{"backends": {"a": {"kind": "x"}}}', '{"backends": {"a": {"kind": "openai"}}}', '{"routes": {"table": "z"}}'):
        with pytest.raises(ValueError):
            backends.Routing.parse(bad)
    with pytest.raises(ValueError):
        routing.resolve("table", "z")


def test_perspective():
    source, target = [(10, 20), (110, 25), (105, 60), (8, 55)], [(0, 0), (100, 0), (100, 32), (0, 32)]
    m = detection.perspective(source, target)
    for (x, y), (u, v) in zip(source, target):
        w = m[6] * u + m[7] * v + m[8]
        assert abs((m[0] * u + m[1] * v + m[2]) / w - x) < 1e-6 and abs((m[3] * u + m[4] * v + m[5]) / w - y) < 1e-6
    assert detection.perspective([(0, 0)] * 4, [(0, 0)] * 4) == [1, 0, 0, 0, 1, 0, 0, 0, 1]


CTC = ([0, 1, 1, 0, 2, 3], [0.9, 0.8, 0.7, 0.9, 0.85, 0.95], "abc", (0.8 + 0.85 + 0.95) / 3), ([0, 0, 0, 0], [0.9] * 4, "", 0.0), ([1, 0, 1], [0.9, 0.8, 0.7], "aa", 0.8), ([1, 1, 1], [0.9, 0.8, 0.7], "a", 0.9), ([2], [0.75], "b", 0.75)


def test_ctc(spark):
    from vellum.operators import sequence

    rows = [(k, i, s, c) for k, (symbols, scores, _, _) in enumerate(CTC) for i, (s, c) in enumerate(zip(symbols, scores))]
    found = {r["seq_id"]: r for r in sequence.ctc_collapse(spark.createDataFrame(rows, "seq_id long, step int, symbol int, score double")).collect()}
    for k, (_, _, text, score) in enumerate(CTC):
        assert "".join(" abc"[s] for s in found[k]["symbols"]) == text and abs(found[k]["score"] - score) < 1e-9


@pytest.mark.parametrize(
    "cells, lines, expected",
    [
        ([(0, 0, 100, 100)], [(10, 10, 90, 90), (95, 95, 195, 195)], {0: [0]}),
        ([(0, 0, 50, 50)], [(200, 200, 300, 300)], {}),
        ([(0, 0, 100, 100), (100, 0, 200, 100)], [(60, 10, 120, 90)], {0: [0]}),
        ([(0, 0, 120, 100), (80, 0, 200, 100)], [(70, 10, 130, 90)], {0: [0], 1: [0]}),
        ([(0, 0, 100, 100), (100, 0, 200, 100)], [(50, 10, 150, 90)], {0: [0]}),
    ],
)
def test_cell_match(spark, cells, lines, expected):
    from vellum.operators import tables

    schema = "page_id long, {} int, x0 int, y0 int, x1 int, y1 int"
    c = spark.createDataFrame([(1, i, *b) for i, b in enumerate(cells)], schema.format("cell_id"))
    found = {}
    for r in tables.match_cells(spark.createDataFrame([(1, i, *b) for i, b in enumerate(lines)], schema.format("line_id")), c).orderBy("cell_id", "position").collect():
        found.setdefault(r["cell_id"], []).append(r["line_id"])
    assert found == expected


@pytest.mark.parametrize("class_id, score, tier", [(21, 700, "trust"), (21, 600, "trust"), (21, 500, "verify"), (21, 350, "verify"), (21, 200, "fallback"), (5, 550, "trust"), (5, 400, "verify"), (5, 100, "fallback"), (22, 500, "trust"), (22, 300, "verify"), (22, 50, "fallback"), (-1, 450, "trust")])
def test_tiers(spark, class_id, score, tier):
    from pyspark.sql import functions as F

    from vellum.functions import dims

    frame = dims.with_class(spark.createDataFrame([(class_id, score)], "class_id int, score int"), "trust_milli", "verify_milli")
    assert frame.select(dims.tier(F.col("score"))).first()[0] == tier


def test_text_cases(spark):
    from pyspark.sql import functions as F

    from vellum.functions import text as t
    from vellum.operators import tables

    one = lambda text, f: spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]
    headings = {"1 Introduction": ("NUM_LIST", 1), "1.1 Background": ("NUM_LIST", 2), "1.2.3 Deep": ("NUM_LIST", 3), "(1) Bracketed": ("NUM_LIST_BRACKET", 4), "1) Half": ("NUM_LIST_BRACKET", 4), "IV. Roman": ("ROMAN", 1), "A. Letter": ("LETTER", 2), "Plain Heading": (None, None)}
    frame = spark.createDataFrame([(x,) for x in headings], "x string")
    kind, level = t.numbering(F.col("x"))
    assert {r["x"]: (r["k"], r["l"]) for r in frame.select("x", kind.alias("k"), level.alias("l")).collect()} == headings
    assert one("<table><td onclick='x()' style=\"a\" colspan=\"2\">a</td></table><script>alert(1)</script>", t.sanitize) == '<table><td colspan="2">a</td></table>'
    assert one('<a href="javascript:x">link</a>', t.sanitize) == "link" and one("<script>alert(1)</script> & <img src=x>", t.cell_escape).startswith("&lt;script&gt;")
    assert one("（１）", t.normal_text) == "(1)" and one("<b>Header</b>", t.cell_escape) == "<b>Header</b>"
    assert one("<fcel>a<fcel>b<nl><fcel>c<fcel>d<nl>", tables.otsl_html) == "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    assert one("", tables.otsl_html) == "" and 'rowspan="2"' in one("<fcel>A<fcel>B<nl><ucel><fcel>D<nl>", tables.otsl_html)
