"""Edits between whole texts, against brute force."""

import random
import time

import pytest

from tests.test_whole import edits as brute
from tests.test_whole import stored
from vellum.functions import edits as e
from vellum.plans.catalog import QUERIES


def made():
    r, pairs = random.Random(7), [("", ""), ("", "x"), (None, "x"), ("x", None), ("ab" * 40, "ab" * 40)]
    for k in range(120):
        letters = ("ab", "abcdefgh ", "漢字é😀ab", "".join(map(chr, range(200, 900))))[k % 4]
        text = lambda *sizes: "".join(r.choices(letters, k=r.choice(sizes)))
        left, right = text(1, 5, 63, 64, 65, 128, 130, 200), text(1, 2, 63, 64, 65, 127, 129, 260)
        pairs.append((left, left[: len(left) // 3] + right[:3] + left[len(left) // 2 :] if k % 3 == 0 else right))
    return pairs


# Groups of one pair and of many, few steps between two looks, and tables of matches that are cut.
@pytest.mark.parametrize("limits", [{}, {"WORDS": 1, "STEPS": 7}, {"WORDS": 20}, {"TABLE_BYTES": 300}])
def test_edits_are_those_of_the_whole_table(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(e, name, value)
    left, right = zip(*made())
    assert e.edits(left, right) == [None if a is None or b is None else brute(a, b) for a, b in zip(left, right)]


def test_character_errors_of_long_texts_take_seconds(spark, tmp_path):
    # Cell by cell a table of 60,000 by 60,000 takes over half a minute. The first letter goes and comes back at the end.
    path = stored(spark, tmp_path, "documents", [(0, "ab" * 30_000, "en", "a"), (1, "ba" * 30_000, "en", "a"), (2, None, "en", "a"), (3, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    QUERIES["character_errors"](spark, path).where("id = 2").collect()  # starts the session and its workers
    began = time.time()
    found = {r["id"]: r for r in QUERIES["character_errors"](spark, path).collect()}
    assert time.time() - began < 20
    assert found[0]["cer"] == 2 / 60_000 and found[2]["cer"] is None and found[2]["overall"] is None
