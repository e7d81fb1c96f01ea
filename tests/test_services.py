"""Requests, samples, broken bytes, formulas, retries, files and Markdown for scores, against plain loops and literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import latex, recognizer
from vellum.functions import text as t
from vellum.operators import render, sampling, sequence
from vellum.sources import files


def plain_sample(items, most):
    """Step by step over all items: (id, table, formula, text, strata)."""
    taken, out, have = {}, [], {"t": 0, "f": 0}

    def take(x):
        out.append(x[0])
        for k, v in enumerate(x[4]):
            taken[k, v] = taken.get((k, v), 0) + 1

    def best(pool):
        return min((x for x in pool if x[0] not in out), key=lambda x: (sum(taken.get(s, 0) for s in enumerate(x[4])), x[0]), default=None)

    for x in items:
        if x[1] and x[2]:
            take(x)
    have = {"t": len(out), "f": len(out)}
    table, formula = [x for x in items if x[1] and not x[2]], [x for x in items if x[2] and not x[1]]
    while len(out) < most:
        a, b = best(table), best(formula)
        if a is None and b is None:
            break
        kind = "t" if a and (b is None or have["t"] <= have["f"]) else "f"
        take(a if kind == "t" else b)
        have[kind] += 1
    for pool in ([x for x in items if x[3] and not x[1] and not x[2]], items):
        while len(out) < most and (x := best(pool)):
            take(x)
    return sorted(out)


@pytest.mark.parametrize("seed, most", [(1, 25), (2, 60), (3, 5), (4, 500)])
def test_samples(spark, seed, most):
    rnd = random.Random(seed)
    items = [(i, rnd.random() < 0.1, rnd.random() < 0.1, rnd.random() < 0.8, (rnd.choice("ab"), rnd.choice(["x", "y", None]), rnd.randint(0, 2))) for i in range(150)]
    frame = spark.createDataFrame([(i, a, b, c, *s) for i, a, b, c, s in items], "id long, has_table boolean, has_formula boolean, has_text boolean, u string, v string, w int")
    assert sorted(r["id"] for r in sampling.flattened(frame, ("u", "v", "w"), most).collect()) == plain_sample(items, most)


def plain_utf8(raw):
    out, i = b"", 0
    while i < len(raw):
        c = raw[i]
        n = 1 if c < 0x80 else 2 if c >> 5 == 6 else 3 if c >> 4 == 14 else 4 if c >> 3 == 30 else 0
        if n and i + n <= len(raw) and all(x >> 6 == 2 for x in raw[i + 1 : i + n]):
            out, i = out + raw[i : i + n], i + n
        else:
            out, i = out + b"\xef\xbf\xbd", i + 1
    return out


def plain_utf16(raw):
    units = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw) - 1, 2)]
    while units and units[-1] == 0:
        units.pop()
    out, i = "", 0
    while i < len(units):
        u, i = units[i], i + 1
        if 0xD800 <= u < 0xDC00 and i < len(units) and 0xDC00 <= units[i] < 0xE000:
            u, i = 0x10000 + ((u - 0xD800) << 10) + units[i] - 0xDC00, i + 1
        elif 0xD800 <= u < 0xE000:
            u = 0xFFFD
        out += chr(u)
    return out.encode()


def test_broken_bytes(spark):
    rnd = random.Random(8)
    some = [0x41, 0x20, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xF8, 0x80, 0xBF, 0x00, 0x0A, 0xD8, 0xDC, 0x3D]
    rows = [(i, bytes(rnd.choice(some) for _ in range(rnd.randint(0, 14)))) for i in range(3000)] + [(9000, b"x\xc3\xa9" * 100_000)]
    frame = spark.createDataFrame(rows, "i long, b binary").select("i", t.repaired_utf8(F.col("b")).cast("binary").alias("u"), t.utf16_text(F.col("b")).cast("binary").alias("w"))
    for r in frame.collect():
        raw = dict(rows[r["i"] : r["i"] + 1] or [rows[-1]]).get(r["i"], rows[-1][1])
        assert bytes(r["u"]) == plain_utf8(raw) and bytes(r["w"]) == plain_utf16(raw), raw[:30]


def test_byte_level_tokens(spark):
    alphabet = sequence.byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256)) and alphabet["Ġ"] == 32 and alphabet["Ċ"] == 10 and alphabet["é"] == 0xE9
    chars = {b: c for c, b in alphabet.items()}
    words = ["é漢 x", "  pad ", "\\frac{1}{2}", "", "line\nend"]
    vocabulary = spark.createDataFrame([(k, "".join(chars[b] for b in w.encode())) for k, w in enumerate(words)] + [(90, "a b"), (91, "漢")], "id long, token string")
    ids = [(1, [0, 2, 99, 0]), (2, [1, 50, 2, 7, 1]), (3, []), (4, [3, 4]), (5, [90, 91])]
    found = {r["seq_id"]: r["text"] for r in sequence.token_texts(spark.createDataFrame(ids, "seq_id long, ids array<long>"), vocabulary, 99, (50,)).collect()}
    assert found == {1: "é漢 x\\frac{1}{2}", 2: "pad \\frac{1}{2}  pad", 3: "", 4: "line\nend", 5: "a b漢"}


@pytest.mark.parametrize("safe", [r"\frac{a}{b} \left( x \right)", r"\begin{a}\end{b} \{ x", r"a_1^2", r"x_{a}{}_{b} \\ y", r"\big| x", r"\left\langle x \right.", r"\=a", r"a\_b\^c", r"\left \{ x \right \}", "é"])
def test_safe_formulas(safe):
    assert latex.render_safe(safe)


@pytest.mark.parametrize("odd", [None, "", " ", "{", "}{", r"\left(", r"\right) \left(", r"\end{a}", r"\begin{a}", "x\\", "x^a^b", r"\beta_{}_{f}", "x_ y _z", r"\? x", r"\big -", r"\left\mathrm x \right)", "x_", "x^ ", "a^}", r"\=", r"\= }", "x_{a_b", r"\é"])
def test_unsafe_formulas(odd):
    assert not latex.render_safe(odd)


def test_retries():
    class Model:
        def __init__(self, failures):
            self.failures, self.calls = failures, 0

        def ready(self):
            return True

        def run(self, crops):
            self.calls += 1
            if self.calls <= self.failures:
                raise recognizer.TransientError
            return [("ok", 1.0, None)] * len(crops)

    def tried(failures, **options):
        slept, now = [], [0.0]

        def sleep(s):
            slept.append(round(s, 3))
            now[0] += s

        model = Model(failures)
        return recognizer.Retrying(model, clock=lambda: now[0], sleep=sleep, draw=lambda: 0.5, **options).run([b"a", b"b"]), model.calls, slept

    assert tried(0) == ([("ok", 1.0, None)] * 2, 1, [])
    assert tried(2, attempts=4) == ([("ok", 1.0, None)] * 2, 3, [0.062, 0.125])
    assert tried(9, attempts=3) == ([("", 0.0, "transport_error")] * 2, 3, [0.062, 0.125])
    assert tried(9, attempts=9, budget_s=0.3)[1:] == (3, [0.062, 0.125]) and tried(99, attempts=8)[2][-1] == tried(99, attempts=9)[2][-1] == 1.0
    assert recognizer.Retrying(Model(0), draw=lambda: 0).wait_s(0) == 0.05


def test_file_scans(spark, tmp_path):
    for name, raw in (("a.png", b"\x89PNG\r\n\x1a\n" + b"x" * 20), ("b.jpg", b"\xff\xd8\xff\xe0"), ("c.pdf", b"%PDF-1.7"), ("deep/d.webp", b"RIFF\x01\x02\x03\x04WEBPVP8 "), ("e.wav", b"RIFF\x01\x02\x03\x04WAVE"), ("f.raw", b"x" * 24), ("g", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in files.files(spark, str(tmp_path)).collect()}
    assert kinds == {"a.png": "png", "b.jpg": "jpeg", "c.pdf": "pdf", "d.webp": "webp", "e.wav": None, "f.raw": None}
    assert files.images(spark, str(tmp_path)).count() == 3 and [r["length"] for r in files.documents(spark, str(tmp_path)).collect()] == [8]
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.pixels(spark, str(tmp_path), 4, 2, 3).collect()}
    assert errors["f.raw"] is None and errors["a.png"] == "BODY_SIZE_MISMATCH"


def test_markdown_for_scores(spark):
    box = "x0 int, y0 int, x1 int, y1 int"
    layout = [(1, 0, "doc_title", 0, 0, 100, 10), (1, 1, "reference", 0, 50, 100, 60), (1, 2, "text", 0, 20, 100, 40), (1, 3, "header", 0, 0, 9, 9), (1, 4, "table", 0, 70, 9, 80), (1, 5, "reference_content", 0, 90, 100, 99), (1, 6, "algorithm", 0, 12, 100, 18), (2, 0, "display_formula", 0, 0, 9, 9)]
    results = [(1, 0, "Title ", 0, 2, 0, 0, 9, 9), (1, 1, "cited", 1, 0, 0, 50, 9, 60), (1, 2, "loose", None, 3, 10, 22, 20, 30), (1, 3, " early", -1, 4, 5, 21, 8, 24), (1, 4, "x = 1", 6, 1, 0, 13, 9, 15), (3, 0, "alone", None, None, 0, 0, 9, 9)]
    found = render.evaluation_markdown(
        spark.createDataFrame(results, "page_id long, id long, text string, layout_id int, place int, " + box), spark.createDataFrame(layout, "page_id long, id int, label string, " + box),
        spark.createDataFrame([], "page_id long, layout_id int, html string"), spark.createDataFrame([(2, 0, " ")], "page_id long, layout_id int, latex string"),
    )
    page = "### References\n\n- cited\n\n```algorithm\nx = 1\n```\n\n# Title\n\nearly loose\n\n<table></table>\n"
    assert {r["page_id"]: r["markdown"] for r in found.collect()} == {1: page, 2: "$$ $$\n", 3: "\n"}
