"""Quality rules, line first: judge each line, take out the failures, then reject documents that lose too much text.

A word is a run of characters other than ASCII white space. Rules of a line that has a word:

- punctuation: marks of ``[#*$%&|<>!]`` on more than half as many places as the line has words;
- navigation: at least three separators (``|``, ``»``, ``•``, ``·``), and one for every four words at least;
- boilerplate: a known phrase of licences and site notices in English, German, French or Spanish, a line equal to an earlier one of its document, or
  a line of six words or more of which over half repeat the word before.

Two base rules judge the whole text before its lines do: too few words, or too many words in repeated three-word windows.

Defined results: a null or empty text has no words and fails the base rules. Copies are judged alike. Rows that repeat an
id are judged one by one. Extra columns are ignored by ``judge`` and kept by ``keep_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import map_text, texts

# Characters counted as symbols, as marks and as separators, and phrases of boilerplate.
SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&|<>!"
SEPARATORS = ("|", "»", "•", "·")
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "use of cookies", "subscribe to our", "sign up for our", "click here", "skip to content",
    "share this", "follow us on", "powered by", "read more",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "newsletter abonnieren", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "conditions générales d", "politique de confidentialité", "accepter les cookies", "cliquez ici", "en savoir plus", "aller au contenu",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "aceptar las cookies", "suscríbete a", "haz clic aquí", "leer más",
)
_BOILERPLATE = [x.encode() for x in BOILERPLATE]
_SEPARATORS = [x.encode() for x in SEPARATORS]

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars")
_TYPES = {"base_failed": "boolean", "kept": "boolean"}


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    window: int = 3
    max_lost_percent: int = 50


def line_fails(line: bytes, seen: bool, phrases: list[bytes] = _BOILERPLATE) -> bool:
    words = line.split()
    n = len(words)
    if seen or 2 * (len(line) - len(line.translate(None, MARKS))) > n:
        return True
    separators = sum(line.count(x) for x in _SEPARATORS)
    if separators >= 3 and 4 * separators >= n:
        return True
    if n >= 6 and 2 * sum(a == b for a, b in zip(words, words[1:])) > n:
        return True
    if not phrases:
        return False
    low = line.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
    return any(x in low for x in phrases)


def repeated_words(words: list[bytes], width: int) -> int:
    """Words in windows of ``width`` that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = bytearray(len(words))
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered[i : i + width] = b"\1" * width
    return sum(covered)


def judge_text(text: str | None, rules: Rules = Rules()) -> tuple[dict, str]:
    """The figures and verdict of one text, and what its lines leave."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    repeats = repeated_words(words, rules.window)
    seen: set[bytes] = set()
    left, lost, with_word, failed, duplicates = [], 0, 0, 0, 0
    low = text.lower().encode("utf-8", "surrogatepass")
    phrases = [x for x in _BOILERPLATE if x in low]
    for line in raw.split(b"\n"):
        if not line or line.isspace():
            continue
        with_word += 1
        again = line in seen
        duplicates += again
        seen.add(line)
        if line_fails(line, again, phrases):
            failed += 1
            lost += len((b"".join(line.split())).decode("utf-8", "surrogatepass"))
        else:
            left.append(line)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not base_failed and 100 * lost <= rules.max_lost_percent * word_chars
    row = dict(zip(COLUMNS, (n, word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicates, repeats, base_failed, kept, with_word, failed, lost)))
    return row, b"\n".join(left).decode("utf-8", "surrogatepass")


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """A row for each row of ``documents``: its figures, verdict and, if asked, the text that its good lines make."""
    kind = documents.schema[id_column].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge_text(x, rules) for x in texts(part, "text")]
        columns = {"id": part.column(0)} | {k: pa.array([r[k] for r, _ in rows], pa.bool_() if k in _TYPES else pa.int64()) for k in COLUMNS}
        if with_text:
            columns["clean_text"] = pa.array([x for _, x in rows], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, " + ", ".join(f"{k} {_TYPES.get(k, 'long')}" for k in COLUMNS) + ", clean_text string" * with_text
    return map_text(documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")), "text", work, schema).withColumnRenamed("id", id_column)


def keep_documents(documents: DataFrame, text_column: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text is kept, with all their columns."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array([judge_text(x, rules)[0]["kept"] for x in texts(part, text_column)], pa.bool_()))

    return map_text(documents, text_column, work, documents.schema)
