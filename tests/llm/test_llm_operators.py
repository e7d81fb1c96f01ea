"""Operators of the language-model part against brute force, and their edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("vellum.llm")
import public_tokenizers as P  # noqa: E402

from vellum.llm import bpe_scan, html_blocks, itq_dedup, language_id, packing, quality_rules, simhash_tiles, token_counts, toxicity, warc_bundles  # noqa: E402
from vellum.llm.common import crc_mod  # noqa: E402
from vellum.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD, PIECE = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def odd_texts():
    rnd = random.Random(5)
    alphabet = list("ab sStmdrevl' \n\t12é漢!?,.😀|") + ["'s", "'re", " 't", "the ", "\x1e", " ", "<|endoftext|>", "İ"]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [None, "", " ", "\n\n", "'", "x" * 3000, "word " * 3000, "same text here", "same text here", *made]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "en", "src", 0) for i, t in enumerate(odd_texts())] + [(None, "no id", None, None, None), (7, "same text here", "en", "s", 0)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, nothing):
    model = language_id.fit(nothing)
    assert language_id.identify(nothing, model).count() == 0 and language_id.keep_documents(nothing, model).count() == 0
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_documents(nothing).columns == nothing.columns
    assert simhash_tiles.near_duplicates(nothing).count() == 0 and simhash_tiles.keep_first(nothing).count() == 0
    assert packing.pack(nothing, WORD).count() == 0 and bpe_scan.encode(nothing, BYTE).count() == 0 and token_counts.count(nothing, PIECE).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert warc_bundles.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert itq_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "one two three", "en", "s", 1, "x", 2.0, 3, "t")]
    docs = spark.createDataFrame(rows, SCHEMA + ", id string, score double, fp int, component_id string")
    model = language_id.fit(docs)
    for out in (language_id.keep_documents(docs, model), quality_rules.keep_documents(docs), simhash_tiles.keep_first(docs)):
        assert out.columns == docs.columns
        out.collect()
    for out in (packing.pack(docs, WORD), bpe_scan.encode(docs, BYTE), token_counts.count(docs, PIECE), simhash_tiles.near_duplicates(docs), quality_rules.judge(docs), language_id.identify(docs, model)):
        assert out.count() == 1


def test_quality_rules():
    def brute(text):
        import re

        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        hits = set()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        for i, j in itertools.combinations(range(len(windows)), 2):
            if windows[i] == windows[j]:
                hits |= {i, i + 1, i + 2, j, j + 1, j + 2}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(hits)

    for text in odd_texts() + ["a b c a b c\na b c a b c\nx"]:
        if text and len(text) > 2000:
            continue
        row, _ = quality_rules.judge_text(text)
        assert tuple(row[k] for k in quality_rules.COLUMNS[:5]) == brute(text)
    rnd = random.Random(8)
    clean = "\n".join(" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(12)) + "." for i in range(30))
    assert quality_rules.judge_text(clean)[0]["kept"]
    junk = "\n".join("".join(f"word{i * j}%%% " for j in range(9)) for i in range(30))
    row, left = quality_rules.judge_text(clean[:300] + "\n" + junk)
    assert not row["base_failed"] and not row["kept"] and "%%%" not in left
    assert quality_rules.line_fails(b"Home | About | News | Contact", False) and quality_rules.line_fails(b"All rights reserved", False)
    assert not quality_rules.line_fails(b"A plain sentence.", False)


def test_byte_bpe(spark, documents):
    import tiktoken

    codec = bpe_scan.Codec.load(BYTE)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rows = bpe_scan.encode(documents, BYTE, with_ids=True)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.where("doc_id is not null").collect()}
    for r in rows.where("doc_id is not null").collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    decoded = bpe_scan.decode(rows.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTE).collect()
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in decoded)


def test_scan_is_associative():
    rnd = np.random.default_rng(3)
    symbols = rnd.integers(0, 9, 5000).astype(np.uint8)
    step, start = bpe_scan.machine()
    state, expected = 0, []
    for s in symbols:
        expected.append(start[s * 8 + state])
        state = step[s * 8 + state]
    for width in (1, 7, 64, 5000):
        assert bpe_scan.starts(symbols, width).tolist() == expected


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD)
    rows = [r for r in packing.pack(documents, WORD, 256).collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    pieces = {}
    for r in rows:
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own_ in pieces.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at
            at += length
        assert at <= 256
    assert len(pieces) <= 1.02 * sum(r["length"] for r in rows) / 256 + 1
    assert sum(r["length"] for r in rows) == sum(len(own.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in documents.collect())


def test_generations_of_known_words():
    from tokenizers import Tokenizer

    own, small = Tokenizer.from_file(WORD), packing.WordTokenizer(WORD, cache=20)
    for _ in range(3):
        for k in range(0, 300, 10):
            parts = [x or "" for x in odd_texts()[9 + k : 19 + k]]
            ids, counts = small.encode_batch(parts)
            expected = [own.encode(x, add_special_tokens=False).ids + [0] for x in parts]
            assert ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))


def best_fit_one_by_one(histogram, sequence):
    gaps = [0] * (sequence + 1)
    made = 0
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        gap = next((g for g in range(x, sequence + 1) if gaps[g]), None)
        if gap is None:
            made, gap = made + 1, sequence
        else:
            gaps[gap] -= 1
        gaps[gap - x] += 1
    return made


@pytest.mark.parametrize("sequence", [16, 64, 300, 2048])
def test_plan_uses_each_piece_once_and_is_no_worse_than_best_fit(sequence):
    rnd = random.Random(sequence)
    for k in range(25):
        low, high = sorted((rnd.randint(1, sequence), rnd.randint(1, sequence)))
        histogram = {rnd.randint(low, high): rnd.randint(1, 12) for _ in range(rnd.randint(1, min(sequence, 150)))}
        used, sequences = {}, 0
        for members, times in packing.plan(histogram, sequence):
            assert 0 < sum(members) <= sequence and times > 0
            sequences += times
            for x in members:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        bound = best_fit_one_by_one(histogram, sequence)
        assert sequences <= bound
        counts = np.bincount(list(histogram), list(histogram.values()), sequence + 1).astype(np.int64)
        assert sum(n for _, n in packing.best_fit(counts, sequence)) == bound


def test_complements_against_brute_force():
    rnd = random.Random(6)
    for _ in range(20):
        counts = np.zeros(41, np.int64)
        for _ in range(rnd.randint(1, 14)):
            counts[rnd.randint(1, 40)] = rnd.randint(1, 3)
        index = packing.Complements(counts)
        for _ in range(60):
            there = [x for x in range(41) for _ in range(index.counts[x])]
            if not there:
                break
            total, held = rnd.randint(1, 40), (rnd.choice(there),)
            there.remove(held[0])
            exists = any(sum(c) == total for n in (1, 2, 3) for c in itertools.combinations(there, n))
            found = index.find(total, held)
            assert (found is not None) == exists
            assert index.fitting(total, held) == max((x for x in there if x <= total), default=0)
            if found:
                assert sum(found) == total and all(found.count(x) <= there.count(x) for x in found)
                if rnd.random() < 0.5:
                    index.use(found, 1)


def test_token_counts():
    pieces = token_counts.Pieces.load(PIECE)

    def brute(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            found = [(best[i][0] + pieces.scores[word[i:j]], best[i][1] - 1) for i in range(max(0, j - 20), j) if word[i:j] in pieces.scores]
            if word[j - 1] not in pieces.scores:
                n = len(word[j - 1].encode())
                found.append((best[j - 1][0] + n * pieces.byte_score, best[j - 1][1] - n))
            best.append(max(found))
        return -best[-1][1]

    words = sorted({"▁" + w for x in odd_texts() if x and len(x) < 1000 for w in x.split()})
    assert token_counts.count_pieces(words, pieces).tolist() == [brute(w) for w in words]
    assert [x.tolist() for x in token_counts.count_batch(["", " \n", "a b"], pieces)] == [[0, 0, 2], [0, 0, 2]]


def test_language_id(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows + [(100, None, "en", "s", 0), (101, "123 !!", "en", "s", 0), (102, "hunde katzen", None, "s", 0)], SCHEMA)
    model = language_id.fit(docs)
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(found[i]["lang_pred"] == ("en" if i % 2 else "de") and 0 <= found[i]["score"] <= 1 for i in range(60))
    assert found[100]["lang_pred"] == found[101]["lang_pred"] == "und" and found[102]["lang_pred"] == "de"
    assert {r["doc_id"] for r in language_id.keep_documents(docs, model).collect()} == {*range(60), 102}


def test_language_id_against_brute_force(spark):
    """A model of plain counts and loops over words, by its definition, on texts of several scripts."""
    rnd = random.Random(13)
    stems = {"en": "the and river house walking", "de": "der und fluß häuser gehend", "hi": "नमस्ते दुनिया किताब हिन्दी", "th": "สวัสดี ที่นี่ ภาษาไทย"}
    rows = [(i, " ".join(rnd.choice(stems[x].split()) + rnd.choice(["", "", "en", "ी"]) for _ in range(8)), x, "s", 0) for i in range(120) for x in [list(stems)[i % 4]]]
    strange = [(500, "wandering wälder hous", None, "s", 0), (501, "किताबें xqxq", None, "s", 0), (502, "ที่ 77 !", None, "s", 0), (503, "ΩΩ", None, "s", 0), (504, "і", None, "s", 0)]
    docs = spark.createDataFrame(rows + strange + [rows[0], (None, rows[1][1], "en", "s", 0)], SCHEMA)
    for least in (1, 2):
        model = language_id.fit(docs, least_count=least)
        learned = rows + [rows[0], (None, rows[1][1], "en", "s", 0)]
        names = sorted(stems)
        counts = [{x: {} for x in names} for _ in range(6)]
        for _, text, lang, *_ in learned:
            for w in text.split():
                for n in range(6):
                    marked = f"\x02{w}\x03" if n > 1 else w
                    for g in [w] if n == 0 else [marked[i : i + n] for i in range(len(marked) - n + 1)]:
                        counts[n][lang][g] = counts[n][lang].get(g, 0) + 1
        kept = [{g for x in names for g in counts[n][x] if n == 1 or sum(counts[n][y].get(g, 0) for y in names) >= least} for n in range(6)]

        def says(n, g):
            logs = [np.log((counts[n][x].get(g, 0) + language_id.ALPHA) / (sum(counts[n][x].values()) + language_id.ALPHA * len(kept[n]))) for x in names]
            return np.array(logs) - np.mean(logs)

        found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
        for i, text, *_ in rows + strange:
            sums, size = np.zeros(4), 0
            for w in "".join(c if c.isalpha() or __import__("unicodedata").category(c)[0] == "M" else " " for c in text.lower()).split():
                size += 1
                if w in kept[0]:
                    sums += says(0, w)
                    continue
                for n in range(5, 0, -1):
                    marked = f"\x02{w}\x03" if n > 1 else w
                    own = [g for g in (marked[k : k + n] for k in range(len(marked) - n + 1)) if g in kept[n]]
                    if own:
                        sums += sum(says(n, g) for g in own) / len(own) * language_id.BACKOFF ** (6 - n)
                        break
            chances = np.exp((sums - sums.max()) / np.sqrt(size))
            assert found[i]["lang_pred"] == names[int(np.argmax(sums))] and found[i]["score"] == pytest.approx(chances.max() / chances.sum(), abs=1e-4), text
    # Ties go to the language that sorts first, deeper backoff tells with less certainty.
    assert found[503]["lang_pred"] == "de" and found[503]["score"] == pytest.approx(0.25)
    known, unknown = (model.predict([x])[1][0] for x in ("the", "rivex"))
    assert known > unknown
    assert language_id.words_of("किताबें, ที่นี่ naïve") == ["किताबें", "ที่นี่", "naïve"] and language_id.words_of("\u0301 1_2") == []


def test_language_model_has_no_limit_of_words(spark):
    words = ["".join("abcdefghijklmnop"[k >> 4 * j & 15] for j in range(5)) for k in range(60_000)]
    rows = [(i, " ".join(words[i % 60 * 1000 : i % 60 * 1000 + 1000]), "en", "s", 0) for i in range(120)]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert len(model.words) == 60_000 and sum(len(x) == 2 for x in model.grams) >= 250


def test_language_held_out(spark):
    """Held-out accuracy on the given table; the fit is by the operator."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(language_id.learnable(docs))
    told = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where((crc_mod(F.col("doc_id"), 4) == 2) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert told.where("lang = lang_pred").count() >= 0.99 * told.count() > 0


def test_toxicity(spark):
    rnd = random.Random(1)
    plain = "table chair house river stone green walk open light paper".split()
    docs, labels = [], []
    for i in range(400):
        words = [rnd.choice(plain) + str(rnd.randint(0, 50)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(30)]
        if i % 4 == 0:
            words[rnd.randint(5, 25)] = rnd.choice(["fool", "wretch", "oaf"])
        docs.append((i, " ".join(words) + ".", "en", "s", 0))
        labels.append((i, int(i % 4 == 0)))
    docs.append((900, "", "en", "s", 0)), docs.append((901, None, "en", "s", 0))
    frame = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(frame, spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int"))
    assert set(model.weights) == {"fool", "wretch", "oaf"}
    found = {r["doc_id"]: r for r in toxicity.score(frame, model, with_events=True).collect()}
    assert all(found[i]["predicted"] == int(i % 4 == 0) for i in range(400)) and found[900]["predicted"] == found[901]["predicted"] == 0
    kinds = lambda x: {k for k, v in model.events(x).items() if v}
    assert kinds("you are a fool") == {"targeted"} and kinds("he said a real fool") == {"reported"} and kinds("not a fool") == {"negated"}
    assert kinds("i will kill you") == {"threat"} and kinds("the fool") == {"plain"} and kinds("kill, you") == set()
    assert kinds("i will not kill you") == {"negated_threat"} and kinds("he said i will kill you") == {"reported_threat"}
    assert kinds('he said: "i will kill you"') == {"reported_threat"} and kinds("he said, you fool") == {"reported"} and kinds("he left: you fool") == {"targeted"}
    assert kinds("you will beat them at chess") == kinds("vous allez frapper") == kinds("she will beat the eggs") == set()
    assert kinds("fool you are") == kinds("you are a fool") == {"targeted"} and kinds("a fool on a hill far from you") == {"plain"}
    assert kinds("she isn’t a fool") == kinds("she isn't a fool") == {"negated"}
    assert kinds("ich werde dich töten") == kinds("te voy a matar") == kinds("je vais te tuer") == kinds("they will hurt you") == {"threat"}
    assert model.events("i will kill you")["threat"] > model.events("i will hurt you")["threat"] > 0
    assert model.features("i will kill you")[2] > model.features("i will not kill you")[2] > 0


def test_grammar_equals_cascade():
    """The composed machine against its transducers run one after the other over whole clauses."""
    rnd = random.Random(11)
    symbols = [toxicity.INSULT, "threat1", "threat2", toxicity.FUTURE, toxicity.SECOND, toxicity.TARGET, toxicity.CLITIC, toxicity.NEGATOR, toxicity.REPORT, toxicity.OTHER]
    seen = set()
    for _ in range(3000):
        clause = [rnd.choice(symbols) for _ in range(rnd.randint(0, 9))]
        marks, left = [], 0
        for x in clause[::-1]:
            marks.append(frozenset({"targeted"} if left and x == toxicity.INSULT else ()))
            left = toxicity.REACH if x in (toxicity.SECOND, toxicity.TARGET, toxicity.CLITIC) else max(0, left - 1)
        tape = list(zip(clause, marks[::-1]))
        for part in (toxicity.Negation(), toxicity.Reported(), toxicity.Targeted(), toxicity.Threat(), toxicity.Insult()):
            state, then = 0, []
            for x, own in tape:
                state, x, own = part.step(state, x, own)
                then.append((x, own))
            tape = then
        want = [(i, *x[1:]) for i, (x, _) in enumerate(tape) if x[0] == "event"]
        assert toxicity.parse(clause) == want
        seen |= {k for _, k, _ in want}
    assert seen == set(toxicity.EVENTS)


def test_all_evidence_is_learned(spark):
    """No limit to the number of learned words: 6000 of them, each in 30 texts in another order."""
    rnd = random.Random(12)
    spell = lambda k: "".join("abcdefghijklmnopqrstuvwxyz"[k // 26**j % 26] for j in range(3))
    bad = [[spell(7919 * (300 * g + k) % 17576) for k in range(300)] for g in range(20)]
    rows, labels = [], []
    for i in range(1200):
        own = rnd.sample(bad[i // 2 % 20], 300) if i % 2 else [spell(rnd.randint(0, 17575)) + spell(rnd.randint(0, 17575)) for _ in range(60)]
        rows.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, i % 2))
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(model.symbol(w)[0] == toxicity.INSULT for own in bad for w in own)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}


def plain_fingerprint(text):
    """The fingerprint by its definition, bit by bit."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(x >> k & 1 for x in hashes) > len(hashes)) << k for k in range(64))


def test_simhash(spark, documents):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(200)) for _ in range(10)]
    near = [x.replace(" w1", " v1", 1) for x in base]
    docs = documents.unionByName(documents.sparkSession.createDataFrame([(2000 + i, x, "en", "s", 0) for i, x in enumerate(base + near)], SCHEMA))
    rows = [r for r in simhash_tiles.near_duplicates(docs).collect() if r["doc_id"] is not None]
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    own = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert prints == {i: plain_fingerprint(own[i]) for i in prints}
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert all(r["component_id"] == root(r["doc_id"]) for r in rows)
    left = [r["doc_id"] for r in simhash_tiles.keep_first(docs).collect()]
    assert {i for i in left if i is not None} == {i for i in ids if root(i) == i} and None in left


def linked(prints):
    """The smallest place reachable from each place by links within three bits."""
    least = np.arange(len(prints))
    near = [np.flatnonzero(np.bitwise_count(prints.view(np.uint64) ^ np.uint64(int(x) & (1 << 64) - 1)) <= 3) for x in prints]
    while True:
        then = np.array([least[x].min() for x in near])
        if (then == least).all():
            return least
        least = then


def test_intermediate_folders(spark):
    """They are deleted on demand, all or those since a number; without a shared folder only local sessions get one of their own."""
    import os

    from vellum.llm import common

    begun = common.written()
    frames = [common.materialise(spark.range(k + 1).toDF("x"), "test") for k in range(3)]
    paths = common._written[begun:]
    assert [f.count() for f in frames] == [1, 2, 3] and all(map(os.path.exists, (p.removeprefix("file:") for p in paths)))
    common.clean(spark, begun, keep=1)
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, False, True] and common.written() == begun + 1
    common.clean(spark, begun)
    assert common.written() == begun

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "yarn", "getConf": lambda self: {}, "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Far())


@pytest.mark.parametrize("even", [True, False])
def test_simhash_blocks(spark, monkeypatch, even):
    """Blocks of a few rows; with all fingerprints in one tile and in the tiles around it, and spread out."""
    rnd = np.random.default_rng(1)
    if even:
        prints = rnd.integers(0, 1 << 62, 700)
    else:
        quarter = lambda: sum(1 << int(k) for k in rnd.choice(16, 8, replace=False))
        prints = np.array([sum(quarter() << 16 * k for k in range(4)) for _ in range(700)], np.uint64).view(np.int64)
    swapped = prints[:300] ^ np.where((prints[:300] & 3 == 1) | (prints[:300] & 3 == 2), 3, 0)
    prints = np.unique(np.concatenate([prints, swapped, prints[:300] ^ 5, prints[300:500] ^ 1027, prints[:100] ^ 1]))
    want = linked(prints)
    frame = spark.createDataFrame([(int(f), i) for i, f in enumerate(prints)], "fp long, rep long")
    for block, guests in ((7, 3), (1000, 20)):
        monkeypatch.setattr(simhash_tiles, "BLOCK", block)
        monkeypatch.setattr(simhash_tiles, "GUESTS", guests)
        found = {r["node"]: r["component"] for r in components(simhash_tiles.links(frame)).collect()}
        assert found == {i: int(x) for i, x in enumerate(want) if x != i}


def test_sparse_tiles_are_sent_once():
    counts = np.zeros((17,) * 4, np.int64)
    counts[8, 8, 8, 8], counts[8, 8, 8, 7], counts[1, 1, 1, 1] = 10 * simhash_tiles.BLOCK, 5, 5
    homes, visits, dealt = simhash_tiles.divide(counts, 3)
    assert homes[8, 8, 8, 8] == 10 and homes[1, 1, 1, 1] == homes[8, 8, 8, 7] == 1 and visits[1, 1, 1, 1] == 0
    # Ten blocks at home meet one another and the guests; the rest is sent once.
    assert dealt < 15 * counts.sum()


@pytest.mark.parametrize("width", [8, 14])
def test_embeddings(spark, monkeypatch, width):
    """Blocks of few rows, clusters, copies, two lengths of vectors and vectors without links, against brute force."""
    monkeypatch.setattr(itq_dedup, "BLOCK", 40)
    monkeypatch.setattr(itq_dedup, "plan_width", lambda n: width)
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(600, 32))
    x[100:200] = x[:100] + 0.1 * rnd.normal(size=(100, 32))
    x[200:350] = x[0] + 0.05 * rnd.normal(size=(150, 32))
    x[350:380] = x[1]
    few = rnd.normal(size=(6, 5))
    few[3:] = 2 * few[:3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (601, []), (602, [0.0] * 32), (603, [float("nan")] * 32), (604, [None] * 32), (605, [1.0] * 3)]
    rows += [(700 + i, r.tolist()) for i, r in enumerate(few)] + [(None, [1.0] * 32)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, v int")
    got = itq_dedup.near_duplicates(frame).collect()
    found = {r["vec_id"]: r for r in got}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = near.sum(axis=1) - 1
    links = np.array([found[i]["n_links"] for i in range(600)])
    assert (links <= want).all() and links.sum() >= 0.98 * want.sum() and len(got) == 613
    lone = np.arange(101, 200)
    assert links[lone].sum() >= 0.95 * want[lone].sum()
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in range(600, 606))
    assert all(found[i]["n_links"] == 1 and found[i]["component_id"] == 700 + i % 700 % 3 for i in range(700, 706))
    assert found[None]["component_id"] is None and sum(found[i]["kept"] for i in range(600)) <= 600 - 30


def test_warc(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/", big), (2, "http://b/é", big), (3, None, big), (4, "http://c", "small"), (5, "u", "small"), (6, "u\r\nv", None), (7, "u", "é" * 700), (8, "u", "é" * 700), (8, "u", "é" * 700), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, id string, digest int")
    index = warc_bundles.write(warc_bundles.mark_revisits(pages), str(tmp_path), warc_bundles.Options(frame_bytes=2000, bundle_bytes=100))
    found = sorted(((r["id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_bundles.read(index, "long").collect())
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    wide = "é" * 700
    want = [(0, 1500, sha(big), "revisit", 3), (1, 1500, sha(big), "revisit", 3), (2, 1500, sha(big), "revisit", 3), (3, 1500, sha(big), "response", None), (4, 5, sha("small"), "response", None)]
    want += [(5, 5, sha("small"), "response", None), (6, 0, sha(""), "response", None), (7, 1400, sha(wide), "revisit", 8), (8, 1400, sha(wide), "response", None), (8, 1400, sha(wide), "response", None)]
    assert found == want
    # A shuffled index, and a part of it, give the same rows; frames are read in more than one task.
    shuffled = index.orderBy(F.rand(3))
    assert sorted(((r["id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_bundles.read(shuffled, "long").collect()) == want
    assert warc_bundles.fetch(index).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert [r["record_id"] for r in warc_bundles.fetch(index.where("id = 5")).collect()] == [warc_bundles.identifier(5)]
    assert spark.read.parquet(f"{tmp_path}/index").count() == len(rows)
    said = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    for other in (("2", 9, "aa", "response", None), ("3", 5, "aa", "response", None)):
        with pytest.raises(ValueError, match="agree"):
            warc_bundles.check_revisits(spark.createDataFrame([("1", 5, "aa", "revisit", "2"), other], said))
    for r in index.collect():
        headers, block = warc_bundles.read_record(r["file"], r["frame"], r["offset"])
        assert headers["warc-record-id"] == r["record_id"]
    import zstandard

    whole = b""
    for name in {r["file"] for r in index.collect()}:
        with open(name, "rb") as file:
            whole += zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole.count(b"WARC-Type: revisit") == 4


def test_html_blocks():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x --><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One<br>two &lt;b&gt;<p>Three</p><aside>side</aside><form>name</form><div class="comments"><p>me too</p></div><p>Four <a href=x>five</a> six</p></article><footer>&copy; me</footer>"""
    assert html_blocks.main_text(page) == "Head & line\nOne two <b>\nThree\nFour five six"
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<p>") == ""
    assert html_blocks.main_text("<nav>menu<article><p>Body text here</article>") == "Body text here"
    long = " ".join(["word"] * 60)
    assert html_blocks.main_text(f"<div id=menu><a>a</a></div><p>{long}</p><p>Short.</p><p>{long}</p><div class='cookie-notice'>We use</div>") == f"{long}\nShort.\n{long}"
    assert html_blocks.main_text("<article><p>One <b class='x\">two</b> three</p><p>four <a href=\"") == "One two three\nfour"
    assert html_blocks.main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert html_blocks.main_text("<" * 3000 + "a" * 10) is not None


def test_html_neighbours_decide():
    text = lambda n, w="word": " ".join([w] * n)
    tree = html_blocks.tree()
    x, y = html_blocks.table()
    assert all(html_blocks.classify(a, tree) == b for a, b in zip(x, y)) and len(y) < 250
    keeps = lambda *f: html_blocks.classify(f, tree)
    # The same block with other neighbours: (words, links, before, after, place) flips its verdict.
    for words, links, place, good, bad in (
        (4, 1.0, html_blocks.INSIDE, (40, 0.0, 50, 0.0), (3, 1.0, 4, 1.0)),
        (5, 0.0, html_blocks.NO_ARTICLE, (60, 0.0, 70, 0.0), (2, 1.0, 3, 1.0)),
        (6, 1.0, html_blocks.NO_ARTICLE, (80, 0.0, 60, 0.0), (2, 1.0, 2, 1.0)),
        (70, 0.0, html_blocks.OUTSIDE, (90, 0.0, 80, 0.0), (3, 1.0, 4, 1.0)),
        (50, 0.0, html_blocks.HINTED, (60, 0.0, 60, 0.0), (2, 1.0, 3, 0.0)),
    ):
        assert keeps(words, links, *good, place) and not keeps(words, links, *bad, place), (words, links, place)
    # Whatever the neighbours: text in the article is content, and parts apart are not.
    for words, before, after in itertools.product((1, 3, 9, 30, 200), (0, 2, 20, 90), (0, 2, 20, 90)):
        for linked in (0.0, 1.0):
            assert keeps(words, 0.0, before, linked, after, linked, html_blocks.INSIDE) and not keeps(words, 0.0, before, linked, after, linked, html_blocks.APART)
    # The same on pages: a linked item in running text, a paragraph in a div of class form, a body that goes on after its article.
    page = f"<nav><a>home</a></nav><article><h1>Title of it</h1><p>{text(60)}</p><ul><li><a href=x>a linked item</a></li></ul><p>{text(50)}</p></article>"
    assert "a linked item" in html_blocks.main_text(page)
    assert "a linked item" not in html_blocks.main_text(page.replace("</li>", "</li><li><a>more</a></li><li><a>news</a></li>").replace(f"<p>{text(60)}</p>", "<a>x</a>"))
    assert html_blocks.main_text(f"<article><p>{text(60)}</p><div class=form><p>{text(50, 'in')}</p></div><p>{text(60)}</p></article>").count("in") == 50
    assert html_blocks.main_text(f"<article><p>{text(60)}</p></article><form><p>Name</p></form><div><p>{text(150, 'more')}</p><p>{text(140, 'more')}</p></div>").count("more") == 290
    # An article in an aside that ends is a teaser.
    assert html_blocks.main_text(f"<article><p>{text(60)}</p></article><aside><article><p>{text(60, 'teaser')}</p></article></aside>") == text(60)


def test_html_work_grows_with_the_page():
    import time

    def took(n):
        page = "<div>" * n + "</section>" * 3 * n + "<aside>" + "<article>" * n + "</article>" * n + "</aside>" + "<aside><article>" * n
        return min(_timed(time, page) for _ in range(3))

    def _timed(time, page):
        begun = time.perf_counter()
        html_blocks.main_text(page)
        return time.perf_counter() - begun

    assert took(16_000) < 12 * took(4000) + 0.2


def test_html_rows(spark):
    """Against plain loops over rows with ties, repeated ids, nulls, empty pages and clashing columns."""
    rows = [(1, "u", "<article><p>one two</p></article>", "t", 5, "h"), (1, "u", "<article><p>one two</p></article>", "t", 5, "h"), (2, None, None, None, 0, "x"), (None, "v", "", None, 0, ""), (3, "w", "<p>x</p>" * 20_000, "", 1, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, __html string")
    found = sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in html_blocks.extract(pages).collect())
    assert found == sorted((str(i), u, html_blocks.main_text(h), len(html_blocks.main_text(h))) for i, u, h, *_ in rows)


def plain_pipeline(rows, model):
    """What the stages before packing keep, by loops; ``rows`` are (doc_id, text, ...)."""
    names, scores = model.predict([r[1] for r in rows])
    left = [r for r, n, s in zip(rows, names, scores) if n != language_id.UNKNOWN and s >= 0.5]
    left = [r for r in left if quality_rules.judge_text(r[1])[0]["kept"]]
    prints = np.array([plain_fingerprint(r[1]) for r in left], np.uint64)
    parent = {r[0]: r[0] for r in left if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations([i for i, r in enumerate(left) if r[0] is not None], 2):
        if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3:
            x, y = root(left[i][0]), root(left[j][0])
            parent[max(x, y)] = min(x, y)
    kept = {}
    for r in left:
        if r[0] is not None and root(r[0]) == r[0]:
            kept[r[0]] = min(kept.get(r[0], r[1]), r[1])
    return sorted(kept.items()), sorted(r[1] for r in left if r[0] is None)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, copies, near copies, clashing extra columns, and an empty table."""
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(160)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    longest = max(rows, key=lambda r: len(r[1] or ""))
    rows += [(9000, rows[3][1], None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, rows[5][1], "en", "s", 0), (None, rows[5][1], "en", "s", 0)]
    rows += [rows[8], rows[8], (rows[9][0], longest[1], "en", "s", 0), (9003, longest[1] + " one more word", "en", "s", 0), (9004, " ".join([longest[1]] * 30), "en", None, 7)]
    extra = "score double, fp long, component_id string, id int, length int, row string, key int, rank int"
    frame = spark.createDataFrame([(*r, 0.5, 1, "c", 2, 3, "r", 4, 5) for r in rows], SCHEMA + ", " + extra)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(language_id.learnable(frame))
    with_id, without = plain_pipeline(rows, model)
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
    left = docs.collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] is not None) == with_id and sorted(r["text"] for r in left if r["doc_id"] is None) == without
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = Tokenizer.from_file(WORD)
    want = []
    for i, text in with_id + [(None, x) for x in without]:
        ids = np.array(own.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want += [(str(i), k, 2048 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(want)
    empty = str(tmp_path / "none")
    frame.limit(0).write.parquet(empty + "/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    """Operators that the other test of clashes doesn't have, with extra columns named like theirs, repeated rows, ties and null ids."""
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3.0, "y", 1) for i, t in ((1, "you are a fool"), (1, "you are a fool"), (2, "fine"), (None, None))], SCHEMA + ", id string, k int, score double, y string, predicted int")
    labels = spark.createDataFrame([(1, 1, "q", 0), (1, 0, "q", 0), (2, 0, "q", 0), (None, 1, "q", 0)], "doc_id long, toxic int, id string, y int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == 4 and len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "i", "p", "d", 5, "f"), (1, "u", "x" * 2000, "i", "p", "d", 5, "f"), (3, "u", "x" * 2000, "i", "p", "d", 5, "f")], "page_id long, url string, html string, id string, payload string, digest string, n int, refers_to string")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc_bundles.round_trip(pages).collect()) == [(1, "revisit", 3), (1, "revisit", 3), (3, "response", None)]
    told = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(told) == 4


def test_texts_longer_than_a_slice(spark):
    """One text of over 4 MB beside short ones, through every operator on texts."""
    words = "".join(f"wörd{i} and some more words, line {i}.\n" for i in range(130_000))
    assert len(words.encode()) > 4 << 20
    docs = spark.createDataFrame([(1, "short text"), (2, words), (3, "you fool")], "doc_id long, text string")
    one = quality_rules.judge(docs).where("doc_id = 2").first()
    assert one["n_words"] == len(words.split()) and one["word_chars"] == sum(map(len, words.split()))
    assert bpe_scan.encode(docs, BYTE).where("doc_id = 2").first()["decoded_sha256"] == hashlib.sha256(words.encode()).hexdigest()
    pieces = packing.pack(docs, WORD).where("doc_id = 2").collect()
    assert [r["length"] for r in sorted(pieces, key=lambda r: r["piece"])][:-1] == [2048] * (len(pieces) - 1)
    assert int(simhash_tiles.near_duplicates(docs).where("doc_id = 2").first()["fingerprint"], 16) == plain_fingerprint(words)
    assert token_counts.count(docs, PIECE).where("doc_id = 2").count() == 1
    model = toxicity.Model({"fool": 5.0}, np.array([-3.0, 1, 1, 1, 1, 1, 1, 1, 1, 1]))
    assert toxicity.score(docs, model).where("doc_id = 2").first()["predicted"] == 0 < toxicity.score(docs, model).where("doc_id = 3").first()["predicted"]
    assert html_blocks.extract(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), "text").alias("html"))).where("page_id = 2").first()["n_chars"] == len(" ".join(words.split()))


def test_byte_bpe_of_many_scripts():
    import tiktoken

    codec = bpe_scan.Codec.load(BYTE)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    parts = ["हिन्दी में लिखा १२३", "ภาษาไทย ๑๒", "العربية ٣٤", "עִבְרִית", "ქართული ენა", "ᏣᎳᎩ ꮳꮃꭹ", "Ⅷ ½ ²x", "ǅ ʰa", "𝔘𝔫𝔦 𐐷𐐷", "e\u0301e ﬁ", "한국어 조선말", "a\u00a0b\u2003c\u200bd", "ᠮᠣᠩᠭᠣᠯ", "𞤀𞤣𞤤", "இது தமிழ்'s"]
    for x in parts:
        assert codec.encode_batch([x])[0].tolist() == encoding.encode_ordinary(x), x


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(3)
    en, de = "the and of to in is that for it with".split(), "der die und in den von zu das mit sich".split()
    # Words unlike one another, so that texts share few shingles.
    make = lambda common: ". ".join(" ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(12)) + "."
    rows = [(i, make(en if i % 2 else de), "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows += [(100, rows[0][1], "de", "s", 1), (101, None, "en", "s", 0), (102, "%%% " * 80, "en", "s", 0), (103, "short text", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == set(range(40))
