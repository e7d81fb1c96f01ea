"""Best-fit packing of tokenised documents into sequences of bounded length, by exact complements of lengths.

How full sequences get depends on lengths alone, so the plan is made from the histogram of lengths, which has as many rows as a
sequence has tokens, whatever the input. An index by sum lists the single length, the pairs and the triples of lengths with that sum; it is
built for a sum when the sum is first asked for, and combinations leave it for good once their members are used up. From
the longest length down, the plan looks up what fills the gap exactly and is still available, the most even combination first, so that short pieces last.
Where nothing does, the longest piece that fits goes in, and the gap that is left is looked up again. Each combination is used as often as its
scarcest member allows. Plain best fit, longest first, is planned too, and the plan with fewer sequences is used. The plan is a list of
runs: pieces of one length with ranks r to r + n - 1 go to sequences s to s + n - 1 at one offset.

Pieces get their rank among those of their length without a shuffle of texts or ids and without a sort: tasks count as they
tokenise, and the tasks' counts are added up by length. No length, however common, meets in one task.

Defined results: a null text is empty; an empty text is the closing id alone; rows that repeat an id are packed one by one; ties are
placed in any order; extra columns are ignored; an empty table gives an empty result. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bpe_scan import ragged
from vellum.llm.common import materialise, slices, texts

SEQUENCE = 2048
CACHE_WORDS = 300_000
SLICE = 4 << 20
PARTING = "\x1e"
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: ASCII symbols that make a pre-token of their own after a letter, and ASCII letters.
_SYMBOLS, _LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b".,!?;:*%$#&()[]{}=+-_/\\~^`@\"", np.uint8)] = True
_LETTERS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = True


def symbols_begin(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the symbols at the end of each run raw[first:last] begin if they follow a letter of ASCII or Latin-1, else its end."""
    other = np.flatnonzero(~_SYMBOLS[raw])
    at = np.searchsorted(other, last) - 1
    at = np.where(at >= 0, other[np.maximum(at, 0)], -1) if len(other) else np.full(len(last), -1)
    here, before = raw[np.maximum(at, 0)], raw[np.maximum(at - 1, 0)]
    letter = _LETTERS[here] | ((before == 0xC3) & (here >= 0x80) & (here < 0xC0) & (here != 0x97) & (here != 0xB7) & (at > first))
    return np.where((at >= first) & letter, at + 1, last)


class WordTokenizer:
    """Ids of texts by a tokenizer whose pre-tokens never cross ASCII white space, nor go from a letter to a symbol: each different run
    between blanks is encoded once, symbols at its end apart."""

    def __init__(self, path: str, closing: int = 0, cache: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.closing, self.limit = Tokenizer.from_file(path), closing, cache
        (self.parting,) = self.tokenizer.encode(PARTING, add_special_tokens=False).ids
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.closes = np.array([x.endswith("</w>") for x in names])
        self.forget()

    def forget(self) -> None:
        """Starts a new generation of known words. Words of the one before are carried over when they occur again."""
        self.before = getattr(self, "held", ({}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        self.held = ({}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def single(self, word: str) -> bool:
        """Whether the word is one pre-token for sure: letters only, in the form in which the tokenizer sees it."""
        return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in another order, all their ids in a row, and how many each has. Words are encoded many at a time: those of
        one pre-token end where an id has the mark of a word's end; others are parted by a control character that is an id of its own."""
        single, parted, odd = [], [], []
        for raw in words:
            word = raw.decode()
            (single if self.single(word) else odd if PARTING in word else parted).append(word)
        batch = [" ".join(single[i : i + 512]) for i in range(0, len(single), 512)]
        own = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *own])
        count = [np.diff(np.concatenate([[-1], np.flatnonzero(self.closes[ids])]))]
        batch = [f" {PARTING} ".join(parted[i : i + 512]) + f" {PARTING}" for i in range(0, len(parted), 512)]
        own = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        more = np.concatenate([np.zeros(0, np.uint32), *own])
        count.append(np.diff(np.concatenate([[-1], np.flatnonzero(more == self.parting)])) - 1)
        rest = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in odd]
        count.append(np.array([len(x) for x in rest], np.int64))
        return [w.encode() for w in (*single, *parted, *odd)], np.concatenate([ids, more[more != self.parting], *rest]), np.concatenate(count).astype(np.int64)

    def numbers(self, different: list[bytes]) -> np.ndarray:
        """A number for each word, under which ``held`` has its ids; learns those that are new."""
        if len(self.held[0]) > self.limit:
            self.forget()
        known, flat, begin, count = self.held
        missing = [x for x in different if x not in known]
        if missing:
            old, old_flat, old_begin, old_count = self.before
            carried = [x for x in missing if x in old]
            at = np.array([old[x] for x in carried], np.int64)
            fresh, ids, n = self.encode_words([x for x in missing if x not in old])
            n = np.concatenate([old_count[at], n])
            begin = np.concatenate([begin, len(flat) + np.cumsum(n) - n])
            flat, count = np.concatenate([flat, old_flat[ragged(old_begin[at], old_count[at])], ids]), np.concatenate([count, n])
            known.update(zip(carried + fresh, range(len(known), len(known) + len(missing))))
            self.held = (known, flat, begin, count)
        return np.array([known[x] for x in different], np.int64)

    def encode_batch(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's closed by the closing id, and how many each text has."""
        data = ("\n".join(parts) + "\n").encode()
        raw = np.frombuffer(data, np.uint8)
        blank = _BLANKS[raw]
        first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
        ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in parts), np.int64, len(parts)))
        cut = symbols_begin(raw, first, last)
        runs_ = 1 + (cut < last)
        words = np.diff(np.concatenate([[0], np.cumsum(runs_)])[np.concatenate([[0], np.searchsorted(first, ends)])])
        packed = raw[~blank]
        # Ends of the runs of letters and of symbols among the bytes that are no blanks.
        offsets, stops = np.zeros(int(runs_.sum()) + 1, np.int64), np.cumsum(last - first)
        offsets[np.cumsum(runs_)] = stops
        two = runs_ == 2
        offsets[np.cumsum(runs_)[two] - 1] = (stops - (last - cut))[two]
        array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
        coded = array.dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        _, flat, begin, count = self.held
        size = count[number]
        counts = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(words)])]) + 1
        ids = np.full(int(counts.sum()), self.closing, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(counts) - 1] = False
        ids[inside] = flat[ragged(begin[number], size)]
        return ids, counts


_tokenizers: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, closing: int) -> WordTokenizer:
    """One for each worker."""
    if (path, closing) not in _tokenizers:
        _tokenizers[path, closing] = WordTokenizer(path, closing)
    return _tokenizers[path, closing]


def pieces(documents: DataFrame, vocabulary: str, sequence: int = SEQUENCE, closing: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, rank): rank counts the pieces of a length in the task that made them."""
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made = np.zeros(sequence + 1, np.int64)
        for part in slices(batches, "text", SLICE):
            ids, counts = tokenizer(vocabulary, closing).encode_batch([x or "" for x in texts(part, "text")])
            ids = ids.astype("<u4", copy=False)
            cut = -(-counts // sequence)
            row = np.repeat(np.arange(len(counts)), cut)
            piece = ragged(np.zeros(len(cut), np.int64), cut)
            start = piece * sequence
            length = np.minimum(counts[row] - start, sequence)
            at = (np.cumsum(counts) - counts)[row] + start
            order = np.argsort(length, kind="stable")
            of = length[order]
            group = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
            begins = np.flatnonzero(group)
            rank = np.empty(len(length), np.int64)
            rank[order] = made[of] + np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
            made += np.bincount(length, minlength=sequence + 1)
            crc = [zlib.crc32(ids[a : a + n].data) for a, n in zip(at, length)]
            columns = {"id": part.column(0).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            columns |= {"task": pa.array(np.full(len(row), task), pa.int32()), "rank": pa.array(rank, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(at, length)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    return documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")).mapInArrow(run, schema)


class Complements:
    """By sum, the single length, the pairs and the triples of available lengths that make it. Counts only ever fall."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.there = counts.tolist(), counts > 0
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[int]] = {}
        self.alive = np.flatnonzero(counts).tolist()

    def use(self, members: tuple[int, ...], times: int) -> None:
        for x in members:
            self.counts[x] -= times
            if not self.counts[x]:
                del self.alive[bisect_left(self.alive, x)]

    def left(self, wanted: tuple[int, ...], held: tuple[int, ...]) -> bool:
        """Whether the wanted lengths are available beside those that are held."""
        for x in wanted:
            if self.counts[x] < wanted.count(x) + held.count(x):
                return False
        return True

    def pairs_of(self, total: int) -> list[tuple[int, int]]:
        """The pairs with that sum that are available, the least even first."""
        found = self.pairs.get(total)
        if found is None:
            low = np.arange(1, total // 2 + 1)
            low = low[self.there[low] & self.there[total - low]]
            found = self.pairs[total] = list(zip((total - low).tolist(), low.tolist()))
        while found and not self.left(found[-1], ()):
            found.pop()
        return found

    def pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        return next((x for x in reversed(self.pairs_of(total)) if self.left(x, held)), None)

    def triple(self, total: int, held: tuple[int, ...]) -> tuple[int, int, int] | None:
        found = self.triples.get(total)
        if found is None:
            first = np.flatnonzero(self.there[: max(total - 1, 0)])
            found = self.triples[total] = first[np.argsort(-np.abs(3 * first - total), kind="stable")].tolist()
        while found and not (self.counts[found[-1]] and self.pairs_of(total - found[-1])):
            found.pop()
        for first in reversed(found):
            if self.left((first,), held) and (two := self.pair(total - first, (*held, first))):
                return first, *two
        return None

    def find(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        if self.left((total,), held):
            return (total,)
        return self.pair(total, held) or self.triple(total, held)

    def fitting(self, limit: int, held: tuple[int, ...]) -> int:
        """The longest available length up to ``limit``, or 0."""
        at = bisect_right(self.alive, limit) - 1
        while at >= 0 and not self.left((self.alive[at],), held):
            at -= 1
        return self.alive[at] if at >= 0 else 0


def complemented(counts: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan by exact complements: [(lengths, sequences), ...]."""
    made, index = [], Complements(counts)
    for length in range(sequence, 0, -1):
        while index.counts[length]:
            members, gap = (length,), sequence - length
            while gap:
                if found := index.find(gap, members):
                    members += found
                    break
                if not (longest := index.fitting(gap, members)):
                    break
                members += (longest,)
                gap -= longest
            times = min(index.counts[x] // members.count(x) for x in set(members))
            index.use(members, times)
            made.append((members, times))
    return made


def best_fit(counts: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan by best fit, longest first."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            gap = min((g for g, x in open_.items() if g >= length and x), default=sequence)
            members, there = open_[gap].pop() if open_[gap] else ((), n)
            each = gap // length
            full = min(there, n // each)
            if full:
                open_[gap - each * length].append((members + (length,) * each, full))
                n, there = n - full * each, there - full
            if n and there and not full:
                open_[gap - n * length].append((members + (length,) * n, 1))
                n, there = 0, there - 1
            if there and members:
                open_[gap].append((members, there))
    return [x for group in open_.values() for x in group]


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how many sequences do so: [(lengths, sequences), ...]; the better of the two plans."""
    counts = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return min((complemented(counts, sequence), best_fit(counts, sequence)), key=lambda x: sum(n for _, n in x))


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    used, rows, sequence = defaultdict(int), [], 0
    for members, times in patterns:
        offset = 0
        for length in members:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(documents: DataFrame, vocabulary: str, sequence: int = SEQUENCE, closing: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its sequence and place there."""
    found = materialise(pieces(documents, vocabulary, sequence, closing, id_column, text_column, with_ids), "pieces")
    by_task = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    placed = runs(plan({r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}, sequence))
    keys = placed[:, 0] << 48 | placed[:, 1]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("rank"))
    columns = ["id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids]

    def run(batches):
        for part in batches:
            rank, length = part.column(5).to_numpy(), part.column(3).to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            values = [*part.columns[:5], pa.array(placed[at, 2] + rank - placed[at, 1]), pa.array(placed[at, 3]), *part.columns[6:]]
            yield pa.RecordBatch.from_arrays(values, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids])

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return ranked.select(columns).mapInArrow(run, schema).withColumnRenamed("id", id_column)
