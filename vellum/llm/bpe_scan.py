"""Byte-level BPE, encoding and decoding, with vectorised pre-tokenisation.

Text becomes an array of code points and then of symbols: the class of a character (letter, number, other, white space) and what
the next ones make of it (the last of a run of white space, the apostrophe of a contraction). Each symbol is a function from the
eight states of a scanner to its eight states. Composition of functions is associative, so blocks of symbols are composed side by
side, the blocks' functions are scanned, and a second pass over all blocks side by side finds where tokens start. No regular
expression takes part. The slices between starts are numbered by content; each different slice is merged once and cached.

The pattern is that of ``public_tokenizers.PATTERN``: contractions, an optional space with letters, numbers or other characters,
white space up to the last of its run, and white space.

Defined results: a null text is empty; an empty text has no ids and decodes to no bytes; copies have equal results; rows that
repeat an id are encoded one by one; extra columns are ignored; an empty table gives an empty result. Any bytes round trip.
Texts are worked on in slices of a few MB, but one text is never cut, so memory is in proportion to the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import map_text, texts

#: Different slices of which a worker keeps the merged ids.
CACHE_SLICES = 200_000
SLICE = 4 << 20
#: A longer slice is merged by itself, with a heap.
LONG_PIECE = 64
NONE = 1 << 40

L, N, O, INNER, LAST, JOIN, SHORT, LONG, RESET = range(9)
E, IN_L, IN_N, IN_O, IN_SPACE, JOINED, ONE_LEFT, TWO_LEFT = range(8)
# The code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point: letter, number, other or (as INNER) white space."""
    kinds = {"L": L, "N": N}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE_SPACE)] = INNER
    return table


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) by 8 * symbol + state."""
    step, start = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for state in range(8):
        step[L, state] = {TWO_LEFT: ONE_LEFT, ONE_LEFT: E}.get(state, IN_L)
        start[L, state] = state not in (IN_L, JOINED, ONE_LEFT, TWO_LEFT)
        for symbol, to in ((N, IN_N), (O, IN_O)):
            step[symbol, state], start[symbol, state] = to, state not in (to, JOINED)
        for symbol, to in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            inside = state in (IN_O, JOINED)
            step[symbol, state], start[symbol, state] = IN_O if inside else to, not inside
        step[INNER, state], start[INNER, state] = IN_SPACE, state != IN_SPACE
        step[LAST, state], step[JOIN, state], step[RESET, state] = E, JOINED, E
    return step.ravel(), start.ravel()


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """A symbol for each code point; the places in ``resets`` part two texts and have no symbol of their own text."""
    kind = class_table()[points]
    kind[resets] = RESET
    after = np.append(kind[1:], RESET)
    space = kind == INNER
    last = space & (after != INNER) & (after != RESET)
    out = kind
    out[last] = LAST
    out[last & (points == 32)] = JOIN
    marks = np.flatnonzero((points == 39) & (kind == O))
    if len(marks):
        padded = np.concatenate([np.where(kind == RESET, 0, points), np.zeros(2, points.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        is_ = lambda a, text: np.isin(a, [ord(c) for c in text])
        out[marks[is_(one, "stmd")]] = SHORT
        out[marks[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = LONG
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan by composition along axis 0 of [n, 8] functions; what comes later is applied later."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = functions[i][out[i - 1]]
        return out
    width = int(np.ceil(np.sqrt(n)))
    rows = -(-n // width)
    padded = np.tile(np.arange(8, dtype=np.uint8), (rows * width, 1))
    padded[:n] = functions
    grid = padded.reshape(rows, width, 8)
    for k in range(1, width):
        grid[:, k] = np.take_along_axis(grid[:, k], grid[:, k - 1], 1)
    carried = scan(grid[:, -1].copy())
    grid[1:] = np.take_along_axis(grid[1:], np.broadcast_to(carried[:-1, None, :], grid[1:].shape), 2)
    return grid.reshape(-1, 8)[:n]


def starts(symbol: np.ndarray, width: int = 64) -> np.ndarray:
    """Whether a token starts at each place; the state before the first is E."""
    step, start = machine()
    n = len(symbol)
    rows = -(-n // width)
    grid = np.full(rows * width, RESET, np.uint8)
    grid[:n] = symbol
    columns = np.ascontiguousarray(grid.reshape(rows, width).T) << 3
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for k in range(width):
        whole = step[columns[k][:, None] | whole]
    state = np.zeros(rows, np.uint8)
    state[1:] = scan(whole)[:-1, E]
    out = np.empty((width, rows), bool)
    for k in range(width):
        at = columns[k] | state
        out[k], state = start[at], step[at]
    return out.T.reshape(-1)[:n]


def slice_array(parts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The pre-tokens of all texts as one array of bytes, and how many each text has."""
    joined = "\n".join(parts)
    if not joined and len(parts) < 2:
        return pa.array([], pa.binary()), np.zeros(len(parts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    resets = (np.cumsum(lengths) + np.arange(len(parts)))[:-1]
    begins = np.flatnonzero(starts(symbols(points, resets)))
    widths = np.ones(len(points), np.uint8)
    for limit in (0x80, 0x800, 0x10000):
        widths += points >= limit
    places = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    offsets = places[np.append(begins, len(points))]
    data = joined.encode()
    array = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
    parting = np.searchsorted(begins, resets)
    counts = np.diff(np.concatenate([[-1], parting, [len(begins)]])) - 1
    keep = np.ones(len(begins), bool)
    keep[parting] = False
    return array.filter(pa.array(keep)), counts


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those of first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Codec:
    """Ids by ranks: the lowest-ranking pair of neighbours is joined first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE_SLICES):
        self.ranks, self.limit = ranks, cache
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, size)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pairs, self.joined = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.forget()

    def forget(self) -> None:
        """Cached slices: their numbers, and by number where their ids begin in ``flat`` and how many they are."""
        self.known: dict[bytes, int] = {}
        self.flat, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair of ids makes; NONE if that is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all pieces in a row, and how many each has. Every round joins one pair in each piece that still has one."""
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        short = np.array([i for i, x in enumerate(pieces) if len(x) <= LONG_PIECE], np.int64)
        for i, x in enumerate(pieces):
            if len(x) > LONG_PIECE:
                done[i] = np.array(self.merge_long(x), np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
        size = np.fromiter((len(pieces[i]) for i in short), np.int64, len(short))
        finished_ids, finished_size, finished_piece = [], [], []
        rank = None
        while len(short):
            ends = np.cumsum(size)
            if rank is None:
                rank = np.append(self.rank_of(ids[:-1], ids[1:]), NONE)
                rank[ends - 1] = NONE
            least = np.minimum.reduceat(rank, ends - size)
            active = least != NONE
            if not active.all():
                there = np.repeat(active, size)
                finished_ids.append(ids[~there])
                finished_size.append(size[~active])
                finished_piece.append(short[~active])
                ids, rank, size, short, least = ids[there], rank[there], size[active], short[active], least[active]
                if not len(short):
                    break
                ends = np.cumsum(size)
            equal = np.flatnonzero(rank == np.repeat(least, size))
            of = np.searchsorted(ends, equal, side="right")
            at = equal[np.concatenate([[True], of[1:] != of[:-1]])]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, size = ids[keep], rank[keep], size - 1
            ends = np.cumsum(size)
            at = at - np.arange(len(at))
            inner = at != ends - 1
            rank[at[~inner]] = NONE
            rank[at[inner]] = self.rank_of(ids[at[inner]], ids[at[inner] + 1])
            inner = at != ends - size
            rank[at[inner] - 1] = self.rank_of(ids[at[inner] - 1], ids[at[inner]])
        long = [i for i, x in enumerate(pieces) if len(x) > LONG_PIECE]
        order = np.concatenate([*finished_piece, np.array(long, np.int64)])
        sizes = np.concatenate([*finished_size, np.array([len(done[i]) for i in long], np.int64)])
        flat = np.concatenate([*finished_ids, *(done[i] for i in long)]) if len(order) else np.zeros(0, np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        first = (np.cumsum(sizes) - sizes)[back]
        return flat[ragged(first, sizes[back])].astype(np.uint32), sizes[back]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and links, for pieces in which a list would be searched too often."""
        import heapq

        ranks, n = self.ranks, len(piece)
        ends, before = [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := ends[i]) >= n or ends[j] != end or not alive[j]:
                continue
            alive[j], ends[i] = 0, end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        return tuple(ranks[piece[i : ends[i]]] for i in range(n) if alive[i])

    def encode_batch(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        pieces, counts = slice_array(parts)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        coded = pieces.dictionary_encode()
        if len(self.known) > self.limit:
            self.forget()
        different = coded.dictionary.to_pylist()
        numbers = [self.known.get(x, -1) for x in different]
        if new := [x for x, number in zip(different, numbers) if number < 0]:
            flat, count = self.merge(new)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, flat])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            numbers = [self.known[x] for x in different]
        number = np.array(numbers, np.int64)[coded.indices.to_numpy()]
        size = self.count[number]
        ids = self.flat[ragged(self.begin[number], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.firsts[ids], self.sizes[ids])]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker."""
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def encode(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each row of ``documents``: number and digest of its ids, digest of what they decode to and, if asked, the ids."""
    kind = documents.schema[id_column].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        ids, counts = own.encode_batch([x or "" for x in texts(part, "text")])
        ends = np.cumsum(counts)
        ids = ids.astype("<u4", copy=False)
        decoded = own.decode(ids)
        places = np.concatenate([[0], np.cumsum(own.sizes[ids])])
        columns = {"id": part.column(0), "n_tokens": pa.array(counts, pa.int64())}
        columns["ids_sha256"] = pa.array([hashlib.sha256(ids[e - n : e].data).hexdigest() for n, e in zip(counts, ends)], pa.string())
        columns["decoded_sha256"] = pa.array([hashlib.sha256(decoded[places[e - n] : places[e]].data).hexdigest() for n, e in zip(counts, ends)], pa.string())
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_text(documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")), "text", work, schema, SLICE).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The bytes of each row's ids; a null list has no bytes. Ids outside of the vocabulary are an error."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        for part in batches:
            own = codec(vocabulary)
            rows = part.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "decoded": pa.array([own.decode(np.asarray(x or [], np.int64)).tobytes() for x in rows], pa.binary())})

    return encoded.select(encoded[id_column].alias("id"), encoded[ids_column].alias("ids")).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_column)
