"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat verb of a grade, future word, second person, other target, negator, report verb or other. Transducers
rewrite the symbols of a clause one after the other, and are composed into one machine whose states are made as they are met:

- negation marks what stands up to ``REACH`` words after a negator;
- reported speech marks what follows a report verb in its clause, or in the clause that quotes begin after it;
- target marks insults that stand near a word for a person, before or after it: it runs from left to right in the cascade, and from right to left before it;
- threat turns a future word, a threat verb and a target, or a future word, a target and a threat verb, into one event, with the marks
  of its verb and the weight of the verb's grade; where the second person is the subject of the future word there is no threat;
- insult turns an insult, with the marks that it has by then, into an event with the weight of its word.

A clause has one score for each kind of event, the largest weight of it. A text's features are the sums over its clauses, of each kind and
of all with negated and reported ones at ``SPARED`` of their weight, and a logistic model turns them into the score.

Fitting reads at most ``rows_per_label`` labelled rows of either label, chosen by a hash of the id. Of copies and near copies, told by the
least hashes of their shingles, one is used. Insult words and stems (prefixes) are all those whose evidence, that they are more frequent in
texts of label 1 than chance allows, is ``EVIDENCE`` nats at least. The logistic model is fitted to features measured with words learned from
the other half of the sample; where the labels were sampled at different rates, its constant is corrected for them.

Defined results: null and empty texts have no clause and get the score of no event; so does every text if nothing was learned. Copies
score alike; rows that repeat an id are scored one by one; null labels are not learned from; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_text, materialise, texts

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;:,\n()\"“”«»]")
ENDS = frozenset('.!?;:,\n()"“”«»')
#: Ends of clauses that may stand between a report verb and what it reports.
QUOTES = frozenset(',:"“”«»')
INSULT, FUTURE, SECOND, TARGET, CLITIC, NEGATOR, REPORT, OTHER = "insult", "future", "second", "target", "clitic", "negator", "report", "other"
#: Weights of threat verbs by grade.
GRADES = {"threat1": 1.0, "threat2": 2.0}
# Words of the grammar in English, German, French and Spanish.
WORDS = {
    "threat2": "kill murder shoot stab töten umbringen ermorden erschießen tuer assassiner abattre matar asesinar apuñalar",
    "threat1": "hurt destroy beat punish crush hit smash burn verletzen schlagen vernichten verprügeln frapper détruire écraser brûler golpear destruir aplastar quemar",
    FUTURE: "will shall gonna going i'll we'll they'll he'll she'll werde werden wird vais allons va vont voy vamos van",
    SECOND: "you ye du ihr tu vous tú usted ustedes vosotros",
    TARGET: "your yours you're yourself he him his she her they them their dich dir dein deine euch euer sie ihn ihm ihnen toi ton ta votre vos il elle ils elles les ti tus su él ella ellos ellas",
    CLITIC: "te os",
    NEGATOR: "not no never isn't aren't wasn't weren't don't doesn't didn't won't can't nicht kein keine keinen nie niemals ne n'est pas jamais aucun nunca jamás ningún",
    REPORT: "said says say called calls wrote writes told quoted claimed sagte sagt schrieb nannte behauptete dit écrit appelé affirmé dijo dice escribió llamó",
}
REACH = 3
STEM = (4, 5, 6, 7, 8)
EVENTS = ("plain", "targeted", "negated", "reported", "threat", "negated_threat", "reported_threat")
#: Share of their weight at which negated and reported events count in the sum of all.
SPARED = 0.3
#: Least evidence for an insult, in nats, and least number of texts of label 1 with it.
EVIDENCE, LEAST_TEXTS = 10.0, 4
CACHE_WORDS = 300_000


NO_MARKS: frozenset = frozenset()


class Transducer:
    """Reads (symbol, marks) and writes (symbol, marks); the first state is 0. An event is written as the symbol ("event", kind, weight),
    where no weight means that of the word."""

    def step(self, state, symbol, marks: frozenset) -> tuple:
        raise NotImplementedError


def spoken_of(marks: frozenset) -> str | None:
    """Why what has these marks isn't said in earnest."""
    return next((m for m in ("reported", "negated") if m in marks), None)


class Negation(Transducer):
    def step(self, state, symbol, marks):
        if symbol == NEGATOR:
            return REACH, symbol, marks
        return max(0, state - 1), symbol, marks | {"negated"} if state else marks


class Reported(Transducer):
    def step(self, state, symbol, marks):
        return int(state or symbol == REPORT), symbol, marks | {"reported"} if state else marks


class Targeted(Transducer):
    def step(self, state, symbol, marks):
        if symbol in (SECOND, TARGET, CLITIC):
            return REACH, symbol, marks
        return max(0, state - 1), symbol, marks | {"targeted"} if state and symbol == INSULT else marks


class Threat(Transducer):
    """States: 0; "theirs" after a second person that may be a subject, and after its future word; ("clitic", 1) after a target that may go before a future word;
    ("future", words left); ("object", words left) where a target followed the future word or a clitic went before it; (grade, words left, why not in earnest) after a verb."""

    def step(self, state, symbol, marks):
        left = state[1] - 1 if isinstance(state, tuple) else 0
        kind = state[0] if isinstance(state, tuple) else state
        if symbol == FUTURE:
            return ("theirs" if kind == "theirs" else ("object", REACH) if kind == "clitic" else ("future", REACH)), symbol, marks
        if symbol in GRADES:
            if kind == "object":
                return 0, self.event(symbol, spoken_of(marks)), marks
            return ((symbol, REACH, spoken_of(marks)) if kind == "future" else 0), symbol, marks
        if symbol in (SECOND, TARGET, CLITIC):
            if kind in GRADES:
                return 0, self.event(kind, state[2]), marks
            if kind == "future":
                return ("object", REACH), symbol, marks
            return {SECOND: "theirs", CLITIC: ("clitic", 1)}.get(symbol, 0), symbol, marks
        if left > 0 and kind != "clitic":
            return (kind, left, *state[2:]), symbol, marks
        return 0, symbol, marks

    @staticmethod
    def event(grade: str, why: str | None) -> tuple:
        return "event", f"{why}_threat" if why else "threat", GRADES[grade]


class Insult(Transducer):
    def step(self, state, symbol, marks):
        if symbol != INSULT:
            return 0, symbol, marks
        return 0, ("event", spoken_of(marks) or ("targeted" if "targeted" in marks else "plain"), None), marks


class Composed:
    """A cascade as one machine over symbols; states are tuples, and transitions are kept once met."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start, self.table = parts, (0,) * len(parts), {}

    def step(self, state: tuple, symbol, marks: frozenset = NO_MARKS) -> tuple:
        if (found := self.table.get((state, symbol, marks))) is None:
            then, out, now = [], symbol, marks
            for part, own in zip(self.parts, state):
                after, out, now = part.step(own, out, now)
                then.append(after)
            found = self.table[state, symbol, marks] = (tuple(then), out, now)
        return found


BACKWARD = Composed(Targeted())
GRAMMAR = Composed(Negation(), Reported(), Targeted(), Threat(), Insult())
#: The state in which a clause begins that a report verb leads to.
QUOTED = (0, 1, 0, 0, 0)


def parse(symbols: list[str], quoted: bool = False) -> list[tuple[int, str, float | None]]:
    """(place, kind, weight or None for that of the word) of the events of a clause."""
    marks, state = [NO_MARKS] * len(symbols), BACKWARD.start
    for i in range(len(symbols) - 1, -1, -1):
        state, _, marks[i] = BACKWARD.step(state, symbols[i])
    out, state = [], QUOTED if quoted else GRAMMAR.start
    for i, symbol in enumerate(symbols):
        state, found, _ = GRAMMAR.step(state, symbol, marks[i])
        if found[0] == "event":
            out.append((i, *found[1:]))
    return out


_CLASS = {w: kind for kind, text in WORDS.items() for w in text.split()}


@dataclass
class Model:
    """weights: of insult words; of stems with a trailing ``*``. coefficients: of the features, the constant first."""

    weights: dict[str, float]
    coefficients: np.ndarray | None = None
    cache: dict[str, tuple[str, float]] = field(default_factory=dict)

    def symbol(self, word: str) -> tuple[str, float]:
        if (found := self.cache.get(word)) is None:
            weight = self.weights.get(word)
            for n in STEM[::-1]:
                if weight is None and len(word) > n:
                    weight = self.weights.get(word[:n] + "*")
            found = (INSULT, weight) if weight is not None else (_CLASS.get(word, OTHER), 1.0)
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def events(self, text: str | None) -> dict[str, float]:
        """Sum over clauses of the clause's score, by kind of event."""
        total = dict.fromkeys(EVENTS, 0.0)
        tokens = TOKEN.findall((text or "").lower().replace("’", "'"))
        read, known = self.symbol, self.cache
        symbols = [known.get(t) or read(t) for t in tokens]
        hits = [i for i, s in enumerate(symbols) if s[0] is INSULT or s[0] in GRADES]
        done = 0
        for hit in hits:
            if hit < done:
                continue
            begin = hit
            while begin > done and tokens[begin - 1] not in ENDS:
                begin -= 1
            before = begin - 1
            while before >= done and tokens[before] in QUOTES:
                before -= 1
            end = hit
            while end < len(tokens) and tokens[end] not in ENDS:
                end += 1
            best: dict[str, float] = {}
            for at, kind, weight in parse([s for s, _ in symbols[begin:end]], 0 <= before < begin - 1 and symbols[before][0] == REPORT):
                best[kind] = max(best.get(kind, 0.0), symbols[begin + at][1] if weight is None else weight)
            done = end
            for kind, weight in best.items():
                total[kind] += weight
        return total

    def features(self, text: str | None) -> list[float]:
        found = self.events(text)
        whole = sum(v * (SPARED if k.startswith(("negated", "reported")) else 1.0) for k, v in found.items())
        return [1.0, float(whole > 0), float(np.log1p(whole)), *(float(np.log1p(found[k])) for k in EVENTS)]

    def scores(self, parts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in parts], np.float64).reshape(len(parts), 3 + len(EVENTS))
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients by Newton's method; the first, the constant, is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def items(text: str | None) -> set[str]:
    """The words of a text and their stems."""
    words = {t for t in TOKEN.findall((text or "").lower().replace("’", "'")) if t not in ENDS and len(t) > 2}
    return words | {w[:n] + "*" for w in words for n in STEM if len(w) > n}


def shingle_minima(text: str | None, width: int = 3, seeds: int = 4) -> list[int]:
    """Least hashes of the text's word shingles, by which copies and near copies are told."""
    import xxhash

    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))], np.uint64)
    odd = np.arange(seeds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    mixed = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(29))) * odd
    return [int(x) for x in (mixed ^ (mixed >> np.uint64(32))).min(axis=0).view(np.int64)]


def one_of_each(rows: list[tuple[int, int, list[int]]]) -> set[int]:
    """Of (id, label, minima), the ids of the first row of each group that shares a least hash at a place, directly or not."""
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, (_, _, own) in enumerate(rows):
        for key in enumerate(own):
            j = root(first.setdefault(key, i))
            parent[max(j, root(i))] = min(j, root(i))
    return {x for i, (x, _, _) in enumerate(rows) if root(i) == i}


def weigh(rows: list, folds: tuple[int, ...], ones: int, zeros: int) -> dict[str, float]:
    """Log odds of the items whose evidence in those folds is enough; rows have item, a0, b0, a1, b1. A stem that one word makes up is left out."""
    base, out, single = ones / max(1, ones + zeros), {}, Counter()
    for r in rows:
        if not r["item"].endswith("*"):
            for n in STEM:
                single[r["item"][:n] + "*"] = max(single[r["item"][:n] + "*"], sum(r[f"a{k}"] for k in folds))
    for r in rows:
        a, b = sum(r[f"a{k}"] for k in folds), sum(r[f"b{k}"] for k in folds)
        if 10 * single[r["item"]] >= 9 * a:
            continue
        if a >= LEAST_TEXTS and a / (a + b) > base and a * np.log(a / (a + b) / base) + (b * np.log(b / (a + b) / (1 - base)) if b else 0) >= EVIDENCE:
            out[r["item"]] = float(np.log((a + 0.5) / (ones + 1)) - np.log((b + 0.5) / (zeros + 1)))
    return out


def enough(folds: tuple[int, ...], ones: int, zeros: int):
    """The evidence rule of ``weigh`` as a column, over a0, b0, a1, b1; a little wider, so that the word that makes up a stem comes with it."""
    a, b = (sum((F.col(f"{x}{k}") for k in folds), F.lit(0)) for x in "ab")
    base, share = ones / max(1, ones + zeros), a / (a + b)
    evidence = a * F.log(share / base) + F.when(b > 0, b * F.log((1 - share) / (1 - base))).otherwise(0)
    return (a >= LEAST_TEXTS) & (share > base) & (evidence >= 0.85 * EVIDENCE)


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows_per_label: int = 5000) -> Model:
    """``labels`` has the ids and labels to learn from, and at most about ``2 * rows_per_label`` of its rows are used."""
    given = labels.select(labels[id_column].alias("id"), labels[label_column].cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    there = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = [0.0] * (2 + len(EVENTS))
    if len(there) < 2:
        return Model({}, np.array([4.0 if there.get(1) else -4.0, *none]))
    share = F.when(F.col("y") == 1, F.lit(rows_per_label / there[1])).otherwise(F.lit(rows_per_label / there[0]))
    chosen = given.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30) < share)
    # About 2 * rows_per_label rows of two numbers at most are broadcast.
    sample = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")).join(F.broadcast(chosen), "id").select(F.xxhash64("id", "text").alias("k"), "y", "text")
    sample = materialise(sample, "labelled")

    def minima(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([shingle_minima(t) for t in texts(part, "text")], pa.list_(pa.int64()))], ["k", "y", "m"])

    rows = sorted((r["k"], r["y"], r["m"]) for r in map_text(sample, "text", minima, "k long, y int, m array<long>").collect())
    kept = one_of_each(rows)
    size = Counter((k % 2, y) for k, y, _ in rows if k in kept)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        found = {(fold, y): Counter() for fold in (0, 1) for y in (0, 1)}
        for k, y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part, "text")):
            if k in kept:
                found[k % 2, y].update(items(text))
        every = list(set().union(*found.values()))
        return pa.RecordBatch.from_pydict({"item": pa.array(every, pa.string())} | {f"{'ba'[y]}{fold}": pa.array([found[fold, y][x] for x in every], pa.int64()) for y in (1, 0) for fold in (0, 1)})

    counted = map_text(sample, "text", count, "item string, a0 long, a1 long, b0 long, b1 long").groupBy("item").agg(*(F.sum(x).alias(x) for x in ("a0", "a1", "b0", "b1")))
    ones, zeros = (sum(n for (_, y), n in size.items() if y == k) for k in (1, 0))
    if not ones or not zeros:
        return Model({}, np.array([4.0 if ones else -4.0, *none]))
    # What a half of the sample or the whole of it has evidence for.
    rule = enough((0, 1), ones, zeros)
    for k in (0, 1):
        rule = rule | (enough((k,), size[k, 1], size[k, 0]) if size[k, 1] and size[k, 0] else F.lit(False))
    found = counted.where((F.col("a0") + F.col("a1") > 0) & rule).collect()
    halves = [Model(weigh(found, (k,), size[k, 1], size[k, 0])) for k in (0, 1)]
    model = Model(weigh(found, (0, 1), ones, zeros))

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        # A text is measured with what was learned from the other half.
        own = [(y, halves[1 - k % 2].features(t)) for k, y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part, "text")) if k in kept]
        return pa.RecordBatch.from_pydict({"y": pa.array([y for y, _ in own], pa.int32()), "x": pa.array([x for _, x in own], pa.list_(pa.float64()))})

    measured = sorted((r["y"], r["x"]) for r in map_text(sample, "text", measure, "y int, x array<double>").collect())
    model.coefficients = logistic(np.array([x for _, x in measured]), np.array([y for y, _ in measured]))
    model.coefficients[0] -= np.log(min(1.0, rows_per_label / there[1]) / min(1.0, rows_per_label / there[0]))
    return model


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", with_events: bool = False) -> DataFrame:
    """(id, score, predicted) for each row of ``documents`` and, if asked, the sums of its matched clauses by kind of event."""
    kind = documents.schema[id_column].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(Model(model.weights, model.coefficients))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        own = texts(part, "text")
        found = sent.value.scores(own)
        columns = {"id": part.column(0), "score": pa.array(found), "predicted": pa.array((found >= 0.5).astype(np.int32))}
        if with_events:
            columns["events"] = pa.array([sent.value.events(t) for t in own], pa.struct([(k, pa.float64()) for k in EVENTS]))
        return pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, score double, predicted int" + f", events struct<{','.join(f'{k}:double' for k in EVENTS)}>" * with_events
    return map_text(documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")), "text", work, schema).withColumnRenamed("id", id_column)
