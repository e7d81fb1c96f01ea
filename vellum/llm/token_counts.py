"""Token counts of texts by a unigram model, with dynamic programming shared in a trie.

The different pre-tokens of a slice of texts go into a trie. A node stands for a prefix, however many pre-tokens share it, and gets its
forward score once: the best sum of log probabilities of pieces that make up the prefix, and the number of those pieces. All nodes of a
depth are worked on together. A node carries the pieces that are under way, as states in the trie of pieces, so every step is a lookup of (state, character) and exact.
Nodes where pre-tokens end hold their counts, and a text's count is the sum over its pre-tokens.

The vocabulary is that of a given tokenizer file; it is not trained. Where the file has ranks and no probabilities, a piece of rank
r gets the probability of Zipf's law, in proportion to 1 / (r + 1). A character in no piece counts as its UTF-8 bytes, each less probable than any piece. Of equal sums the one of fewer pieces counts.

Defined results: null and empty texts, and texts of white space, have no tokens; copies have equal counts; rows that repeat an id are
counted one by one; extra columns are ignored; an empty table gives an empty result. Long pre-tokens cost memory in proportion to their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.bpe_scan import ragged
from vellum.llm.common import map_text, texts

MARK = "▁"
#: How much less probable than the last piece a byte is, in nats.
BYTE_PENALTY = 10.0
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


class Pieces:
    """The trie of pieces: sorted transitions, and the score of each state that ends a piece."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        states, ends = {}, {}
        for piece, score in scores.items():
            state = 0
            for c in map(ord, piece):
                state = states.setdefault(state << 21 | c, len(states) + 1)
            ends[state] = score
        keys = np.array(sorted(states), np.int64)
        self.keys, self.to = keys, np.array([states[k] for k in keys.tolist()], np.int64)
        self.end = np.full(len(states) + 1, -np.inf)
        self.end[list(ends)] = list(ends.values())

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        total = float(np.log(sum(1.0 / (r + 1) for r in range(len(plain)))))
        scores = {model.id_to_piece(i): float(-np.log(r + 1) - total) for r, i in enumerate(plain)}
        return cls(scores, min(scores.values()) - BYTE_PENALTY)

    def step(self, state: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The state after a character, or -1."""
        key = state << 21 | points
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


def count_pieces(words: list[str], pieces: Pieces) -> np.ndarray:
    """Number of pieces of each word."""
    n = len(words)
    out = np.zeros(n, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    node = np.zeros(n, np.int64)  # of each word that is still long enough, at the present depth
    alive = np.flatnonzero(sizes > 0)
    best, count = np.zeros(1), np.zeros(1, np.int64)
    # What is under way, in the order of nodes: where each node's list begins, and for each entry score and count at its start, and state.
    lists = np.array([0, 1])
    at_score, at_count, state = np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = 0
    while len(alive):
        here = points[first[alive] + depth]
        key, index = np.unique(node[alive] << 21 | here, return_inverse=True)
        parent, char = key >> 21, key & ((1 << 21) - 1)
        size = lists[parent + 1] - lists[parent]
        take = ragged(lists[parent], size)
        of = np.repeat(np.arange(len(key)), size)
        to = pieces.step(state[take], char[of])
        live = to >= 0
        take, of, to = take[live], of[live], to[live]
        ends = pieces.end[to] > -np.inf
        # Candidates: pieces that end here, and the character as bytes where it is no piece by itself.
        single = pieces.step(np.zeros(len(key), np.int64), char)
        bare = np.where(single >= 0, pieces.end[single], -np.inf) == -np.inf
        width = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        who = np.concatenate([of[ends], np.flatnonzero(bare)])
        score = np.concatenate([at_score[take[ends]] + pieces.end[to[ends]], best[parent[bare]] + width[bare] * pieces.byte_score])
        number = np.concatenate([at_count[take[ends]] + 1, count[parent[bare]] + width[bare]])
        order = np.lexsort((number, -score, who))
        lead = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])]
        best, count = score[lead], number[lead]
        # Pieces under way go on, and others may start after this node.
        fresh = np.arange(len(key))
        owner = np.concatenate([of, fresh])
        arrange = np.argsort(owner, kind="stable")
        at_score = np.concatenate([at_score[take], best])[arrange]
        at_count = np.concatenate([at_count[take], count])[arrange]
        state = np.concatenate([to, np.zeros(len(key), np.int64)])[arrange]
        lists = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(key)))])
        node[alive] = index
        depth += 1
        done = sizes[alive] == depth
        out[alive[done]] = count[index[done]]
        alive = alive[~done]
    return out


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One for each worker."""
    if path not in _pieces:
        _pieces[path] = Pieces.load(path)
    return _pieces[path]


def count_batch(parts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(pre-tokens, tokens) of each text."""
    data = ("\n".join(parts) + "\n").encode()
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANKS[raw]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in parts), np.int64, len(parts)))
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[~blank].tobytes())])
    coded = array.dictionary_encode()
    if not len(coded):
        return np.diff(bounds), np.zeros(len(parts), np.int64)
    each = count_pieces([MARK + w for w in coded.dictionary.to_pylist()], pieces)[coded.indices.to_numpy()]
    return np.diff(bounds), np.diff(np.concatenate([[0], np.cumsum(each)])[bounds])


def count(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) for each row of ``documents``; no shuffle."""
    kind = documents.schema[id_column].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        words, tokens = count_batch([x or "" for x in texts(part, "text")], pieces_of(vocabulary))
        return pa.RecordBatch.from_pydict({"id": part.column(0), "n_pretokens": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    return map_text(documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")), "text", work, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_column)
