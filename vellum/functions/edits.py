"""Edits between texts (X12): exact Levenshtein distances over code points, 64 cells of the table to a machine word, the words of many pairs at a time.

A pair's shorter text stands for the rows of the table, its longer one for the columns. A row's step to the next column and a column's step to the next row are
1, 0 or -1, so the table is kept as bits of these steps (Myers 1999, Hyyrö 2003). Word w of a pair is at column t - w in step t: what it needs of the word
above it comes from the step before, and so all words of all pairs of a group take a step at once.
"""

from __future__ import annotations

import numpy as np

#: Words that take a step at once, steps between two looks at which pairs are through, and bytes of a group's table of matches.
WORDS, STEPS, TABLE_BYTES = 8192, 128, 64 << 20
_ONE, _TOP, _FULL = np.uint64(1), np.uint64(63), np.uint64(2**64 - 1)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def differing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two texts, the shorter one first, without what they have in common at both ends, which no edit touches."""
    for _ in range(2):
        n = len(x)
        unlike = x != y[:n]
        first = int(unlike.argmax()) if unlike.any() else n
        x, y = x[first:][::-1], y[first:][::-1]
    return x, y


class Symbols:
    """Numbers for the code points of a text, from 1; 0 for those of the other text that it doesn't have."""

    def __init__(self):
        self.number, self.last = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)

    def of(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        places = np.arange(len(x))
        self.last[x] = places
        each = x[self.last[x] == places]
        self.number[each] = np.arange(1, len(each) + 1)
        found = self.number[x], self.number[y], len(each) + 1
        self.number[each] = 0
        return found


class Pair:
    """Rows x and columns y of a table. ``above``: the steps of the row over the first one from column to column, as bits not up and bits down; none: all up."""

    def __init__(self, symbols: Symbols, x: np.ndarray, y: np.ndarray, above=None):
        self.rows, self.columns, self.above = len(x), len(y), above
        self.words = -(-len(x) // 64)
        self.end = len(y) + self.words - 1
        # Rows are made up to whole words by rows before the first one, which hand on what they get.
        self.pad = self.words * 64 - len(x)
        xs, ys, n = symbols.of(x, y)
        at = np.arange(self.pad, self.words * 64)
        self.matches = np.zeros(n * self.words, np.uint64)
        np.add.at(self.matches, xs * self.words + (at >> 6), _ONE << (at & 63).astype(np.uint64))
        self.symbols = ys * self.words


def steps_below(pairs: list[Pair], keep: bool = False):
    """For each pair, whose ends descend, the sum of the last row's steps; with ``keep``, of a single pair, also the steps."""
    count = np.array([p.words for p in pairs])
    first = np.cumsum(count) - count
    below, ends = first + count, np.array([p.end for p in pairs])
    base = np.cumsum([0, *(len(p.matches) for p in pairs[:-1])])
    matches = np.concatenate([p.matches for p in pairs])
    width, live = int(count.sum()), len(pairs)
    word = np.arange(width) - np.repeat(first, count)
    up, down = np.full(width, _FULL), np.zeros(width, np.uint64)
    up[first] = _FULL << np.array([p.pad for p in pairs], np.uint64)
    # Steps along a row that enter each word, as bits not up and bits down; those that leave it are in the place after. Words that haven't begun pass on nothing and so stay as they are.
    level, level2 = np.ones(width + 1, np.uint64), np.ones(width + 1, np.uint64)
    minus, minus2 = np.zeros(width + 1, np.uint64), np.zeros(width + 1, np.uint64)
    level[first] = 0
    index, x, d, h = np.empty(width, np.int64), *(np.empty(width, np.uint64) for _ in range(3))
    # A symbol goes down a word in each step: the window on the line of symbols moves a place to the left instead.
    line = np.empty(width + STEPS, np.int64)
    line[STEPS:] = np.repeat(base, count)
    sums, kept = np.zeros(len(pairs), np.int64), []
    t = 0
    while live:
        new = np.repeat(base[:live, None], STEPS, axis=1)
        for k, p in enumerate(pairs[:live]):
            part = p.symbols[t : t + STEPS]
            new[k, : len(part)] += part
        new = np.ascontiguousarray(new.T)
        not_up, gone_down = np.empty((STEPS, live), np.uint64), np.empty((STEPS, live), np.uint64)
        above = pairs[0].above
        for s in range(STEPS):
            now = line[STEPS - 1 - s : STEPS - 1 - s + width]
            now[first] = new[s]
            if above is not None and t + s < pairs[0].columns:
                level[0], minus[0] = above[0][t + s], above[1][t + s]
            np.add(now, word, index)
            matches.take(index, out=x, mode="clip")
            np.bitwise_or(x, minus[:-1], x)
            # d: the cell is as the one above and to the left.
            np.bitwise_and(x, up, d)
            np.add(d, up, d)
            np.bitwise_xor(d, up, d)
            np.bitwise_or(d, x, d)
            np.bitwise_or(d, down, d)
            # Along the row, x: not up, h: down; first within the row, then as seen from the row below.
            np.bitwise_or(d, up, x)
            np.bitwise_xor(x, down, x)
            np.bitwise_and(d, up, h)
            np.right_shift(x, _TOP, level2[1:])
            np.right_shift(h, _TOP, minus2[1:])
            np.add(x, x, x)
            np.bitwise_or(x, level[:-1], x)
            np.add(h, h, h)
            np.bitwise_or(h, minus[:-1], h)
            np.bitwise_or(d, x, up)
            np.bitwise_xor(up, x, down)
            np.bitwise_xor(up, d, up)
            np.bitwise_or(up, h, up)
            level2.take(below, out=not_up[s], mode="clip")
            minus2.take(below, out=gone_down[s], mode="clip")
            level2[first] = 0
            minus2[first] = 0
            level, level2, minus, minus2 = level2, level, minus2, minus
        if keep:
            kept.append((not_up[:, 0], gone_down[:, 0]))
        steps = 1 - not_up.view(np.int64) - gone_down.view(np.int64)
        t += STEPS
        still = int(np.searchsorted(-ends[:live], -t, side="left"))
        sums[:still] += steps[:, :still].sum(axis=0)
        for k in range(still, live):
            sums[k] += steps[: ends[k] - (t - STEPS), k].sum()
        if still < live:
            live, width = still, int(below[still - 1]) if still else 0
            first, below = first[:live], below[:live]
            up, down, index, x, d, h, word = (a[:width] for a in (up, down, index, x, d, h, word))
            level, level2, minus, minus2 = (a[: width + 1] for a in (level, level2, minus, minus2))
        line[STEPS : STEPS + width] = line[:width].copy()
    if keep:
        of = slice(pairs[0].words - 1, pairs[0].end)
        return sums, tuple(np.concatenate(k)[of] for k in zip(*kept))
    return sums


def alone(symbols: Symbols, x: np.ndarray, y: np.ndarray, rows: int) -> int:
    """Edits of a pair whose table of matches would be too large: so many rows at a time, whole words but for the first, each lot under the steps that the last one left."""
    above = None
    for end in range(rows - -len(x) % 64, len(x) + rows, rows):
        sums, above = steps_below([Pair(symbols, x[max(0, end - rows) : end], y, above)], keep=True)
    return len(x) + int(sums[0])


def edits(expected: list[str | None], actual: list[str | None]) -> list[int | None]:
    """Edits that turn one text into the other, pair by pair; null if either is."""
    found: list[int | None] = [None] * len(expected)
    symbols, work = Symbols(), []
    for k, (a, b) in enumerate(zip(expected, actual)):
        if a is None or b is None:
            continue
        x, y = (points(z) for z in sorted((a, b), key=len))
        x, y = differing(x, y)
        if len(x):
            work.append((len(y) + len(x) // 64, k, x, y))
        found[k] = len(y)
    group, words, size = [], 0, 0

    def done() -> None:
        nonlocal group, words, size
        if group:
            group.sort(key=lambda g: -g[1].end)
            for (k, p), n in zip(group, steps_below([p for _, p in group])):
                found[k] = p.rows + int(n)
        group, words, size = [], 0, 0

    for _, k, x, y in sorted(work, key=lambda w: (-w[0], w[1])):
        # No more symbols than the shorter text has places; a table of so many and of all words may be too large.
        if len(x) ** 2 // 8 > TABLE_BYTES and (bytes_ := (len(np.unique(x)) + 1) * len(x) // 8) > TABLE_BYTES:
            found[k] = alone(symbols, x, y, max(1, len(x) * TABLE_BYTES // bytes_ // 64) * 64)
            continue
        p = Pair(symbols, x, y)
        if group and (words + p.words > WORDS or size + p.matches.nbytes > TABLE_BYTES):
            done()
        group.append((k, p))
        words, size = words + p.words, size + p.matches.nbytes
    done()
    return found
