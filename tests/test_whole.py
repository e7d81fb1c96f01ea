"""Queries over whole texts, against brute force on texts that are longer than any prefix."""

import collections
import hashlib
import re

import pytest

from vellum.plans.catalog import QUERIES


def stored(spark, path, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return str(path)


# Pairs that are alike in their first 200 characters and differ after them.
LONG = [(0, "same " * 60 + "left tail words", "en", "a"), (1, "same " * 60 + "right tail", "en", "a"), (2, "grün " * 60 + "ende", "de", "b"), (3, "grün " * 60 + "schluß 漢字", "de", "b")]


@pytest.fixture()
def documents(spark, tmp_path):
    return stored(spark, tmp_path, "documents", LONG, "doc_id long, text string, lang string, source string")


def f1(left, right):
    e, a = (collections.Counter(re.findall("[a-z0-9]+", x.lower())) for x in (left, right))
    both = sum((e & a).values())
    return 2 * both / (sum(e.values()) + sum(a.values()))


def test_word_scores_read_whole_texts(spark, documents):
    found = {r["id"]: r["f1"] for r in QUERIES["word_scores"](spark, documents).collect()}
    assert found == pytest.approx({i: f1(LONG[i][1], LONG[i + 1][1]) for i in (0, 2)}) and max(found.values()) < 1
    means = {(r["lang"], r["source"]): r["mean"] for r in QUERIES["sliced_means"](spark, documents).collect()}
    assert means[None, None] == pytest.approx(sum(found.values()) / 2)


def edits(left, right):
    before = list(range(len(right) + 1))
    for i, x in enumerate(left, 1):
        now = [i]
        for j, y in enumerate(right, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_character_errors_have_every_pair(spark, tmp_path):
    rows = LONG + [(4, "", "en", "a"), (5, "x", "en", "a"), (6, "", "en", "a"), (7, "", "en", "a"), (8, "漢字é", "fr", "b"), (9, "漢é", "fr", "b")]
    path = stored(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string")
    found = {r["id"]: r for r in QUERIES["character_errors"](spark, path).collect()}
    assert sorted(found) == [0, 2, 4, 6, 8]
    for i, r in found.items():
        e, a = rows[i][1], rows[i + 1][1]
        n = edits(e, a)
        assert r["cer"] == pytest.approx(n / len(e) if e else float(bool(a)))
        assert r["overall"] == pytest.approx((1 - n / max(len(e), len(a), 1) + 0.75) / 3 * 100)
        assert r["ratio"] == (len(a) / len(e) if e else None)


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_read_whole_texts(spark, tmp_path):
    text = "a" * 300 + "[x]`\n\nb[EOS] continued"
    path = stored(spark, tmp_path, "documents", [(1, text)], "doc_id long, text string")
    stored(spark, tmp_path, "pages", [(1, text + "</b>")], "page_id long, html string")
    stored(spark, tmp_path, "conversations", [(1, 0, text)], "conv_id long, turn int, text string")
    row = QUERIES["markdown_escapes"](spark, path).collect()[0]
    link = "\\[" + "a" * 300 + "\\[x\\]` b\\[EOS\\] continued\\]\\(a\\\\b\\)"
    assert (row["link"], row["code"], row["tag"]) == (hashed(link), hashed("`` [" + text + "](a\\b) ``"), hashed(text))
    assert QUERIES["decoder_text"](spark, path).collect()[0]["bare"] == hashed(text.replace("[EOS]", ""))
    assert QUERIES["html_escapes"](spark, path).collect()[0]["content"] == hashed(text)
    assert QUERIES["batch_json"](spark, path).collect()[0]["results"] == hashed(text)


def test_neighbours_read_whole_blocks(spark, tmp_path):
    # Of document 4, page 5 begins with a table and page 6 has one after a text; texts between them are furniture by a late keyword.
    for late, n in (("continued", 1), ("none", 0)):
        path = stored(spark, tmp_path / late, "documents", [(k, "x" * 40 + late) for k in (45, 46)], "doc_id long, text string")
        assert QUERIES["table_neighbours"](spark, path).count() == n


def test_counts_read_every_line(spark, tmp_path):
    # Id 4 has the prefix "A. ".
    text = "first\n漢字漢字�\x01Ａ"
    path = stored(spark, tmp_path, "documents", [(4, text)], "doc_id long, text string")
    row = QUERIES["character_counts"](spark, path).collect()[0]
    assert (row["cjk"], row["has_cjk"], row["replaced"], row["controls"]) == (4, True, 1, 1)
    assert QUERIES["cjk_pages"](spark, path).collect()[0]["is_cjk"]
    forms = QUERIES["text_normal_forms"](spark, path).collect()[0]
    assert forms["points"] == 3 + len(text) and forms["half"] == hashed("A. " + text.replace("Ａ", "A")) and forms["lower"] == hashed("a. " + text)
    assert QUERIES["latex_replies"](spark, path).collect()[0]["latex"] == hashed(text)
