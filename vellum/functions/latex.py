"""LaTeX clean-up that runs to a fixed point, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CJK_TEXT = re.compile(r"\\text\s*\{([^{}]*[一-鿿][^{}]*)\}")
_NAMED = re.compile(r"\\(?:operatorname|mathrm|text|mathbf)\s?\*? \{[^{}]*\}")
_NO_LETTER, _LETTER = r"[\W_^\d]", r"[a-zA-Z]"
_SPACES = [re.compile(f"({a})\\s+?({b})", re.A) for a, b in ((_NO_LETTER, _NO_LETTER), (_NO_LETTER, _LETTER), (_LETTER, _NO_LETTER))]


def tidy(latex: str) -> str:
    """CJK out of its text wrapper, no quotation marks, no spaces in named operators, and no spaces but between letters and after a lone backslash."""
    out = _CJK_TEXT.sub(r"\1", latex).replace('"', "")
    out = _NAMED.sub(lambda m: m[0].replace(" ", ""), out)
    join = lambda m: m[0] if m[1] == "\\" and m[0][1] == " " else m[1] + m[2]
    while True:
        new = _SPACES[2].sub(r"\1\2", _SPACES[1].sub(join, _SPACES[0].sub(join, out)))
        if new == out:
            return out
        out = new


def with_tidy(frame: DataFrame, column: str) -> DataFrame:
    """X32 for a column of formulas."""

    def run(texts):
        return texts.map(lambda x: None if x is None else tidy(x))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return frame.withColumn(column, F.pandas_udf(run, "string")(column))


# What a typesetter takes after a backslash, as delimiters, and commands that need one.
ESCAPES, ACCENTS, DELIMITERS = "\\ {}$&#_%~|,;:!.", "=\"'^`", "()[]|./<>"
NAMED_DELIMITERS = frozenset(
    "lbrace rbrace langle rangle lvert rvert lVert rVert vert Vert lfloor rfloor lceil rceil uparrow downarrow Uparrow Downarrow updownarrow backslash".split()
)
SIZED = frozenset("left right big Big bigg Bigg bigl Bigl biggl Biggl bigr Bigr biggr Biggr bigm Bigm biggm Biggm".split())
_PIECES = re.compile(r"\\[A-Za-z]+|\\[\s\S]|[\s\S]")


def render_safe(latex: str | None) -> bool:
    """Whether a typesetter takes the formula: groups, fences and environments pair up, fences and sizes have a delimiter, escapes are known, accents and
    scripts have an argument, and no base has two scripts of a kind."""
    if not (latex or "").strip():
        return False
    pieces = _PIECES.findall(latex)
    # The next piece that is no space, by place; past the end it is empty.
    after = [""] * (len(pieces) + 1)
    for i in range(len(pieces) - 1, -1, -1):
        after[i] = pieces[i] if pieces[i] != " " else after[i + 1]
    depth = {"group": 0, "fence": 0, "environment": 0}
    for i, x in enumerate(pieces):
        follows = after[i + 1]
        change = None
        if x == "\\":
            return False
        if x in ("{", "}"):
            change = ("group", 1 if x == "{" else -1)
        elif x in ("_", "^"):
            if not follows or follows[0] in "_^}])&" or _argument_end(pieces, i + 1) == x:
                return False
        elif len(x) == 2 and not (x[1].isascii() and x[1].isalpha()):
            if x[1] in ACCENTS:
                if not follows or follows[0] in "}])_^":
                    return False
            elif x[1] not in ESCAPES:
                return False
        elif len(x) > 1:
            name = x[1:]
            if name in SIZED and not (follows and follows in DELIMITERS or follows in ("\\{", "\\}", "\\|", "\\\\") or follows[1:] in NAMED_DELIMITERS and follows[0] == "\\"):
                return False
            change = {"left": ("fence", 1), "right": ("fence", -1), "begin": ("environment", 1), "end": ("environment", -1)}.get(name)
        if change:
            depth[change[0]] += change[1]
            if depth[change[0]] < 0:
                return False
    return not any(depth.values())


def _argument_end(pieces: list[str], at: int) -> str:
    """What stands after a script's argument: a group, a command or one character; spaces don't count."""
    while at < len(pieces) and pieces[at] == " ":
        at += 1
    if at < len(pieces) and pieces[at] == "{":
        level = 0
        while at < len(pieces):
            level += {"{": 1, "}": -1}.get(pieces[at][-1], 0) if len(pieces[at]) < 3 else 0
            if not level:
                break
            at += 1
    at += 1
    while at < len(pieces) and pieces[at] == " ":
        at += 1
    return pieces[at] if at < len(pieces) else ""


def with_render_safe(frame: DataFrame, column: str, name: str = "safe") -> DataFrame:
    """X33 as a column."""
    import pandas as pd

    def judged(texts):
        return texts.map(render_safe, na_action=None)

    judged.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return frame.withColumn(name, F.pandas_udf(judged, "boolean")(column))
