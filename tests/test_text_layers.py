"""Text layers of pages with boxes, against plain loops."""

import random

from tests.test_whole import stored
from vellum.operators import pdf
from vellum.plans import page_queries
from vellum.plans.catalog import QUERIES

LAYER = "doc_id long, text string, x0 array<double>, y0 array<double>, x1 array<double>, y1 array<double>"
BOX = "doc_id long, box_id string, x0 double, y0 double, x1 double, y1 double"


def test_text_in_boxes_is_that_of_a_loop(spark):
    r = random.Random(3)
    layers, boxes = [], []
    for doc in (*range(12), 4, 5, None):  # two layers of pages 4 and 5
        text = "".join(r.choices("ab c漢😀\n", k=r.choice((1, 7, 90))))
        x0, y0 = ([r.choice((None, r.uniform(0, 90))) if r.random() < 0.1 else r.uniform(0, 90) for _ in text] for _ in range(2))
        layers.append((doc, text, x0, y0, *([None if v is None else v + 9 for v in side] for side in (x0, y0))))
    layers += [(20, "", [], [], [], []), (21, None, None, None, None, None), (22, "x", [1.0], [1.0], [2.0], [2.0])]
    for doc in (*range(1, 14), 20, 21, None):
        boxes += [(doc, name, *(r.uniform(a, b) for a, b in ((0, 40), (0, 40), (30, 99), (30, 99)))) for name in ("a", "b", "b")]
    boxes += [(3, "null", None, 0.0, 99.0, 99.0), (3, "none", 200.0, 200.0, 300.0, 300.0), (3, None, 0.0, 0.0, 99.0, 99.0)]
    want = {}
    for doc, name, bx0, by0, bx1, by1 in boxes:
        for page, text, *sides in layers:
            for i, (ch, *box) in enumerate(zip(text or "", *(s or [] for s in sides))):
                if doc is not None and page == doc and None not in box and bx0 is not None and 2 * bx0 <= box[0] + box[2] <= 2 * bx1 and 2 * by0 <= box[1] + box[3] <= 2 * by1:
                    want.setdefault((doc, name), []).append((i, ch))
    found = pdf.text_in_boxes(spark.createDataFrame(layers, LAYER), spark.createDataFrame(boxes, BOX)).collect()
    assert sorted(((x["doc_id"], str(x["box_id"])), x["text"]) for x in found) == sorted(((d, str(n)), "".join(ch for _, ch in sorted(rows))) for (d, n), rows in want.items())


def conversations(spark, path):
    return stored(spark, path, "conversations", [(1, 0, "漢字 😀 " + "long text " * 300), (1, 1, ""), (2, 0, None), (None, 0, "x" * 200)], "conv_id long, turn long, text string")


def sent_by_page(frame):
    """No row for each character."""
    return "Generate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_text_in_boxes_sends_pages(spark, tmp_path):
    found = QUERIES["text_in_boxes"](spark, conversations(spark, tmp_path))
    assert sent_by_page(found)
    text = "漢字 😀 " + "long text " * 300 + "\n\ttail  \r\n"
    inside = lambda x0, y0, x1, y1: "".join(ch for i, ch in enumerate(text) if 2 * x0 <= i % 60 * 10 + 5 <= 2 * x1 and 2 * y0 <= i // 60 * 24 + 10 <= 2 * y1)
    assert sorted(tuple(r) for r in found.collect() if r["doc_id"] == 10) == [(10, 0, inside(10, 0, 150, 30)), (10, 1, inside(100, 10, 300, 60))]


def test_verified_results_send_pages(spark, tmp_path):
    found = QUERIES["verified_results"](spark, conversations(spark, tmp_path))
    assert sent_by_page(found)
    rows = {(r["doc_id"], r["box_id"]): (r["text"], r["source"]) for r in found.collect()}
    text, seen = "漢字 😀 " + "long text " * 300, ("seen", "ocr")
    native = {(10, 0): "".join(text[k * 60 + 2 : k * 60 + 30] for k in range(3)), (10, 1): "".join(text[k * 60 + 20 : k * 60 + 60] for k in range(1, 5)), (11, 0): "tail  \r\n"}
    # Pages without text, and those without a number, keep what was seen.
    assert rows == {(doc, box): (native[doc, box], "pdf") if (doc, box) in native else seen for doc in (10, 11, 20, None) for box in range(3)}


def test_long_pages_come_in_pieces(spark, tmp_path):
    texts = {0: "aé漢😀" * 3000 + "b", 1: "é" * 6000, 2: "x" * 6001, 3: "", 4: None, 5: "漢" * 2100, 6: "a" * 2_000_000 + "漢" * 600_000}
    got = {}
    for r in pdf.in_pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), 6000).collect():
        assert len(r["text"]) <= 6000 and r["start"] % 6000 == 0
        got.setdefault(r["doc_id"], []).append((r["start"], r["text"]))
    assert {d: "".join(t for _, t in sorted(x)) for d, x in got.items()} == {d: t for d, t in texts.items() if t is not None}
    assert all([s for s, _ in sorted(x)] == list(range(0, max(1, len(texts[d])), 6000)) for d, x in got.items())
    path = stored(spark, tmp_path, "conversations", [(1, 0, "漢字 😀 " * 100_000)], "conv_id long, turn long, text string")
    assert max(len(r["x0"]) for r in page_queries.layers(spark, path).collect()) <= page_queries.PIECE


def test_pieces_and_layers_of_one_page_are_put_together(spark):
    """A page in pieces, one with many layers, and both; with little held and with all of it."""
    r = random.Random(5)
    layers, boxes, want = [], [], {}
    texts = {1: ["".join(r.choices("ab漢😀", k=900))], 2: ["".join(r.choices("ab漢😀", k=20)) for _ in range(60)], 3: ["".join(r.choices("xyz", k=k)) for k in (500, 90, 300, 500)], 4: ["one"]}
    side = lambda i: (float(i % 30), float(i // 30), float(i % 30 + 1), float(i // 30 + 1))
    for doc, own in texts.items():
        for text in own:
            for first in range(0, len(text), 70):
                piece = text[first : first + 70]
                layers.append((doc, first, piece, *(list(s) for s in zip(*(side(first + i) for i in range(len(piece)))))))
        for box, *corners in ((0, 0.0, 0.0, 99.0, 99.0), (1, 3.0, 0.0, 20.0, 9.0), (1, 10.0, 5.0, 25.0, 15.0), (2, 90.0, 0.0, 99.0, 9.0)):
            boxes.append((doc, box, *corners))
            for text in own:
                for i, ch in enumerate(text):
                    a, b, c, d = side(i)
                    if 2 * corners[0] <= a + c <= 2 * corners[2] and 2 * corners[1] <= b + d <= 2 * corners[3]:
                        want.setdefault((doc, box), []).append((i, ch))
    r.shuffle(layers)
    pages = spark.createDataFrame(layers, "doc_id long, start long, text string, x0 array<double>, y0 array<double>, x1 array<double>, y1 array<double>")
    places = spark.createDataFrame(boxes, "doc_id long, box_id int, x0 double, y0 double, x1 double, y1 double")
    for held in (1, 150, 1 << 20):
        found = {(x["doc_id"], x["box_id"]): x["text"] for x in pdf.text_in_boxes(pages, places, held).collect()}
        assert found == {key: "".join(ch for _, ch in sorted(rows)) for key, rows in want.items()}
