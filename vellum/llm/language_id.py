"""Language identification, words first, with backoff to ever shorter character n-grams.

The model holds, for each known word, its smoothed log frequency in each language. A word that isn't known is scored by its character
5-grams, the ends of the word marked, as far as they are known; if none is, by its 4-grams, and so on down to single characters. What a word
says is by how much its log frequency in each language differs from their mean; a step down to shorter n-grams leaves ``BACKOFF`` of that, so a text
known by short n-grams only is told with less certainty, and known words outweigh unknown ones. A word that has no known character says nothing. A text's score for a language is the
sum over its words; the probabilities are those of the sums divided by the square root of the number of words.

A word is a run of letters and of the marks that combine with them.

Fitting reads a sample of rows that is bounded for each language (``rows_per_language``, chosen by a hash of the id); counts of words and
n-grams are summed before the shuffle. All words and n-grams are used that occur ``least_count`` times at least in the sample, and all single characters:
what was met once has no frequency to speak of. Nothing else is cut, so the model's size is bounded by the sample.

Defined results: a null text, and one without a letter, is ``und`` with score 0, and so is every text if there was nothing to learn
from. Ties go to the language that sorts first. Copies have equal results; rows that repeat an id are judged one by one; extra columns
are ignored by ``identify`` and kept by ``keep_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import crc_mod, map_text, materialise, texts

WORD = re.compile(r"[^\W\d_]+")
#: From here on there are marks that combine with letters.
_LATE = re.compile("[\u0300-\U0010ffff]")
UNKNOWN = "und"
LONGEST = 5
#: Share of what it says that is left to a word at each step down.
BACKOFF = 0.7
ALPHA = 0.5
CACHE_WORDS = 300_000


@lru_cache(1)
def marked_word() -> re.Pattern:
    """Letters with the marks that combine with them, which ``\\w`` doesn't have."""
    marks = "".join(map(chr, (c for c in range(0x300, sys.maxunicode) if unicodedata.category(chr(c))[0] == "M")))
    return re.compile(rf"[^\W\d_](?:[^\W\d_]|[{marks}\u200c\u200d])*")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    text = (text or "").lower()
    return (marked_word() if _LATE.search(text) else WORD).findall(text)


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word, its ends marked unless n is 1; none if it is shorter."""
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """scores has a row for each word and n-gram: log frequencies in the languages, less their mean."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    kept: list[np.ndarray] = field(default_factory=list)

    def vectors(self, words: list[str]) -> np.ndarray:
        """What each word says of each language."""
        rows: list[int] = []
        sizes, shares = [], []
        known, parts = self.words, self.grams
        for word in words:
            if (row := known.get(word)) is not None:
                rows.append(row)
                sizes.append(1)
                shares.append(1.0)
                continue
            found: list[int] = []
            for n in range(LONGEST, 0, -1):
                if found := [row for x in grams(word, n) if (row := parts.get(x)) is not None]:
                    break
            rows += found
            sizes.append(len(found))
            shares.append(BACKOFF ** (LONGEST + 1 - n) / max(1, len(found)))
        out = np.zeros((len(words), len(self.languages)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            size = np.array(sizes)
            begins = (np.cumsum(size) - size)[some]
            out[some] = np.add.reduceat(self.scores[np.array(rows)], begins, axis=0) * np.array(shares, np.float32)[some, None]
        return out

    def predict(self, parts: list[str | None]) -> tuple[list[str], np.ndarray]:
        own = [words_of(x) for x in parts]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        names, score = [UNKNOWN] * len(own), np.zeros(len(own))
        if not self.languages or not sizes.any():
            return names, score
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.kept = {}, []
        coded = pa.array([w for x in own for w in x], pa.large_string()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        fresh = [w for w in different if w not in self.cache]
        if fresh:
            self.cache.update(zip(fresh, range(len(self.cache), len(self.cache) + len(fresh))))
            self.kept = [np.concatenate([*self.kept, self.vectors(fresh)])]
        vectors = self.kept[0][np.array([self.cache[w] for w in different])][coded.indices.to_numpy()]
        at = np.flatnonzero(sizes)
        sums = np.add.reduceat(vectors.astype(np.float64), (np.cumsum(sizes) - sizes)[at], axis=0)
        scaled = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(sizes[at])[:, None]
        chances = np.exp(scaled) / np.exp(scaled).sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        for i, k in zip(at, best):
            names[i] = self.languages[k]
        score[at] = chances[np.arange(len(at)), best]
        return names, score


def count_text(language: str, parts: list[str], into: Counter) -> None:
    for word, n in Counter(w for x in parts for w in words_of(x)).items():
        into[language, 0, word] += n
        for k in range(1, LONGEST + 1):
            for gram in grams(word, k):
                into[language, k, gram] += n


def build(order: np.ndarray, items: list[str], counts: np.ndarray, languages: list[str], totals: np.ndarray) -> Model:
    """A model of items with their order (0 for a word, else n), a row of counts by language each, and the totals by order and language."""
    counts = counts.astype(np.float64)
    scores = np.zeros((len(items), len(languages)))
    for n in range(LONGEST + 1):
        own = order == n
        scores[own] = np.log((counts[own] + ALPHA) / (totals[n] + ALPHA * max(1, own.sum())))
    if languages:
        scores -= scores.mean(axis=1, keepdims=True)
    words = {items[i]: int(i) for i in np.flatnonzero(order == 0)}
    return Model(languages, words, {items[i]: int(i) for i in np.flatnonzero(order > 0)}, scores.astype(np.float32))


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", rows_per_language: int = 2000, least_count: int = 2) -> Model:
    """A model from the rows whose language is not null."""
    given = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"), documents[language_column].alias("lang")).where("lang is not null")
    there = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return build(np.zeros(0, np.int64), [], np.zeros((0, 0)), [], np.zeros((LONGEST + 1, 0)))
    share = F.create_map(*(x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null"))), F.lit(1 << 30)) / float(1 << 30)
    sample = given.where("text is not null").where(place < share[F.col("lang")]).select("lang", "text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        by: dict[str, list[str]] = {}
        for language, text in zip(texts(part, "lang"), texts(part, "text")):
            by.setdefault(language, []).append(text)
        for language, own in by.items():
            count_text(language, own, counts)
        return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in counts], pa.string()), "n": pa.array([k[1] for k in counts], pa.int32()), "gram": pa.array([k[2] for k in counts], pa.string()), "c": pa.array(list(counts.values()), pa.int64())})

    counted = materialise(map_text(sample, "text", work, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "counts")
    languages = sorted({r["lang"] for r in counted.select("lang").distinct().collect()})
    totals = np.zeros((LONGEST + 1, len(languages)))
    for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect():
        totals[r["n"], languages.index(r["lang"])] = r["c"]
    by = F.map_from_entries(F.collect_list(F.struct("lang", "c")))
    whole = counted.groupBy("n", "gram").agg(F.sum("c").alias("total"), by.alias("by")).where((F.col("total") >= least_count) | (F.col("n") == 1))
    # Columns and not rows come to the driver: a few tens of bytes an item.
    found = whole.select("n", "gram", *(F.coalesce(F.col("by")[x], F.lit(0)).alias(f"c{k}") for k, x in enumerate(languages))).toArrow().combine_chunks()
    if not found.num_rows:
        return build(np.zeros(0, np.int64), [], np.zeros((0, len(languages))), languages, totals)
    found = found.sort_by([("n", "ascending"), ("gram", "ascending")])
    counts = np.stack([found.column(k + 2).to_numpy() for k in range(len(languages))], axis=1)
    return build(found.column(0).to_numpy(), found.column(1).to_pylist(), counts, languages, totals)


def identify(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of ``documents``; the model's size is bounded, so it is broadcast."""
    kind = documents.schema[id_column].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names, score = sent.value.predict(texts(part, "text"))
        return pa.RecordBatch.from_pydict({"id": part.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score)})

    return map_text(documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")), "text", work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def keep_documents(documents: DataFrame, model: Model, min_score: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows whose language is told with a score of ``min_score`` at least, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names, score = sent.value.predict(texts(part, text_column))
        return part.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, score)], pa.bool_()))

    return map_text(documents, text_column, work, documents.schema)


def learnable(documents: DataFrame, id_column: str = "doc_id", modulus: int = 4, held_out: int = 2) -> DataFrame:
    return documents.where(crc_mod(documents[id_column], modulus) != held_out)
