"""SimHash near-duplicates by exact comparison in tiles.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 of all word shingles. Different fingerprints are laid out in
tiles by the population counts of their four quarters. Flipping a bit changes one of these counts by one, so fingerprints
that differ in r bits lie in tiles whose counts differ by r in total at most; all other pairs of tiles are skipped.
What is left is compared with exclusive-or and bit counts, every pair once, and no link is lost.

A tile pair is compared where one of the two tiles is at home; fingerprints are sent to the tiles they may have links in. Tiles are
counted first (there are 17 to the power of 4 at most): a tile with more than ``BLOCK`` fingerprints at home or ``GUESTS`` from other tiles is split
into that many blocks of either kind, and only its fingerprints are sent to several cells. So a cell is bounded, however unevenly tiles are filled, and
a fingerprint in sparse tiles is sent once to each. Tasks return a spanning forest of the links they find, not the pairs. Copies share a
fingerprint, which is compared once, so a group of copies of any size is one row there.

Defined results: null and empty texts and texts without words have the fingerprint zero, linked like any other. Texts of fewer words than a
shingle are one shingle. Rows that repeat an id are one document in links, and ``keep_first`` keeps one of them. A row with a null id has a
fingerprint, a null component and no links, and stays. Extra columns are ignored by ``near_duplicates`` and kept by ``keep_first``. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_text, materialise, texts
from vellum.llm.components import Forest, components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints at home in a block, those from other tiles in a block, and rows that a task is dealt at the mean.
BLOCK, GUESTS, DEALT = 16_384, 65_536, 500_000
#: Pairs that are held at a time.
PAIRS = 2 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, chunk: int = 1 << 15) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    firsts, lasts = begins[:n].tolist(), ends[-n:].tolist()
    one, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, chunk):
        hashes = np.array([one(joined[a:b], SEED) for a, b in zip(firsts[i : i + chunk], lasts[i : i + chunk])], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""
    kind = documents.schema[id_column].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x, shingle) for x in texts(part, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({"id": part.column(0), "fp": pa.array(values)})

    return map_text(documents.select(documents[id_column].alias("id"), documents[text_column].alias("text")), "text", work, f"id {kind}, fp long")


def offsets(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of quarter counts within the radius, one of each difference and its negative, and not zero."""
    steps = range(-radius, radius + 1)
    return [d for d in itertools.product(steps, repeat=4) if d > (0, 0, 0, 0) and sum(map(abs, d)) <= radius]


def compare(home: np.ndarray, other: np.ndarray | None, radius: int):
    """Index pairs within the radius, in bounded portions; with itself where ``other`` is None."""
    against = home if other is None else other
    rows = max(1, PAIRS // max(1, len(against)))
    for i in range(0, len(home), rows):
        for j in range(0, len(against), PAIRS):
            if other is None and j + PAIRS <= i:
                continue
            near = np.bitwise_count(home[i : i + rows, None] ^ against[None, j : j + PAIRS]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            if other is None:
                a, b = a[a < b], b[a < b]
            yield a, b


def divide(counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks at home and blocks of guests by tile, an axis for each quarter, and the rows that are dealt to cells."""
    guests = np.zeros_like(counts)
    for d in offsets(radius):
        to, of = (tuple(slice(max(0, s * x), 17 + min(0, s * x)) for x in d) for s in (1, -1))
        guests[to] += counts[of]
    homes, visits = -(-counts // BLOCK), -(-guests // GUESTS)
    return homes, visits, int((counts * np.maximum(homes, visits) + counts * np.maximum(homes - 1, 0) // 2 + guests * homes).sum())


def links(different: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all of (fp, rep) within the radius, as forests found tile by tile."""
    spark = different.sparkSession
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    tile = lambda q: sum(q[k] * 17**k for k in range(4))
    rows = different.select("fp", "rep", *(q.alias(f"q{k}") for k, q in enumerate(quarters))).withColumn("home", tile([F.col(f"q{k}") for k in range(4)]))
    counts = np.zeros((17,) * 4, np.int64)
    for r in rows.groupBy("home").agg(F.count("*").alias("n")).collect():
        counts[tuple(r["home"] // 17**k % 17 for k in range(4))] = r["n"]
    homes, visits, dealt_rows = divide(counts, radius)
    inside = lambda d: " and ".join(f"q{k} + {x} between 0 and 16" for k, x in enumerate(d))
    guests = F.filter(F.array(*(F.when(F.expr(inside(d)), tile([F.col(f"q{k}") + d[k] for k in range(4)])) for d in offsets(radius))), lambda x: x.isNotNull())
    at_home, visiting = rows.select("fp", "rep", F.col("home").alias("tile")), rows.select("fp", "rep", F.explode(guests).alias("tile"))
    if max(homes.max(), visits.max()) > 1:
        # Only tiles of several blocks are in this table, 83521 at the very most.
        split = [(sum(int(x) * 17**k for k, x in enumerate(at)), int(homes[tuple(at)]), int(visits[tuple(at)])) for at in np.argwhere(np.maximum(homes, visits) > 1)]
        split = F.broadcast(spark.createDataFrame(split, "tile int, homes int, visits int"))
        at_home, visiting = (x.join(split, "tile", "left") for x in (at_home, visiting))
        one = F.lit(1)
        own = lambda n: F.pmod(F.xxhash64("fp"), F.greatest(F.coalesce(n, one), one)).cast("int")
        # A block at home is in the cells of all blocks of guests, and of the blocks at home from its own on; there it meets those as guests.
        wide = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("homes"), one), F.coalesce(F.col("visits"), one)) - 1)
        block = at_home.withColumn("own", own(F.col("homes")))
        first = F.transform(wide, lambda x: F.struct(F.col("own").alias("h"), x.alias("g"), F.lit(0).alias("role")))
        again = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda x: F.struct(x.alias("h"), F.col("own").alias("g"), F.lit(1).alias("role")))).otherwise(F.slice(first, 1, 0))
        at_home = block.select("fp", "rep", "tile", F.explode(F.concat(first, again)).alias("at")).select("fp", "rep", "tile", "at.h", "at.g", "at.role")
        # Nobody visits a tile without anyone at home.
        every = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("homes"), one), one) - 1)
        visiting = visiting.where("homes is null or homes > 0").select("fp", "rep", "tile", F.explode(every).alias("h"), own(F.col("visits")).alias("g"), F.lit(2).alias("role"))
        dealt = at_home.unionByName(visiting)
    else:
        dealt = at_home.withColumn("role", F.lit(0)).unionByName(visiting.withColumn("role", F.lit(2))).select("fp", "rep", "tile", F.lit(0).alias("h"), F.lit(0).alias("g"), "role")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-dealt_rows // DEALT))

    def run(batches):
        held = [pa.Table.from_batches([b]) for b in batches]
        if not held:
            return
        whole = pa.concat_tables(held)
        fp, rep, cell, h, g, role = (whole.column(k).to_numpy() for k in ("fp", "rep", "tile", "h", "g", "role"))
        fp = fp.view(np.uint64)
        order = np.lexsort((role, g, h, cell))
        key = (cell[order].astype(np.int64) << 44) | (h[order].astype(np.int64) << 22) | g[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else [], len(key)).astype(np.int64)
        ids, number = np.unique(rep, return_inverse=True)
        forest = Forest(len(ids))
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            home, same, guest = (own[role[own] == k] for k in range(3))
            if not len(home):
                continue
            if h[home[0]] == g[home[0]]:
                for x, y in compare(fp[home], None, radius):
                    forest.link(number[home[x]], number[home[y]])
            elif h[home[0]] < g[home[0]]:
                for x, y in compare(fp[home], fp[same], radius):
                    forest.link(number[home[x]], number[same[y]])
            if len(guest):
                for x, y in compare(fp[home], fp[guest], radius):
                    forest.link(number[home[x]], number[guest[y]])
        found = np.flatnonzero(forest.root != np.arange(len(ids)))
        yield pa.RecordBatch.from_pydict({"u": pa.array(ids[found]), "v": pa.array(ids[forest.root[found]])})

    kind = different.schema["rep"].dataType.simpleString()
    return dealt.repartition(parts, "tile", "h", "g").mapInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``documents``."""
    found = materialise(fingerprints(documents, id_column, text_column, shingle), "fingerprints")
    different = materialise(found.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "different")
    roots = components(links(different, radius))
    classes = different.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    classes = materialise(classes, "classes")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(classes, "fp", "left").select(F.col("id").alias(id_column), text, F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` but those of a document that isn't the one with the smallest id of its component; of rows that repeat an
    id one with the least text. Rows without an id stay."""
    found = near_duplicates(documents, radius, shingle, id_column, text_column)
    dropped = materialise(found.where(F.col(id_column) != F.col("component_id")).select(id_column).distinct(), "dropped")
    left = documents.join(dropped, id_column, "left_anti").select(*documents.columns)
    repeated = found.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1").select(id_column)
    repeated = materialise(repeated, "repeated")
    if not repeated.head(1):
        return left
    # Partial minima meet first, so an id of very many rows is no burden.
    again = left.join(repeated, id_column, "left_semi").select(F.struct(*documents.columns).alias("row"))
    one = again.groupBy(F.col("row").getField(id_column).alias("key")).agg(F.min_by("row", F.struct(F.col("row").getField(text_column))).alias("row")).select("row.*")
    return left.join(repeated, id_column, "left_anti").select(*documents.columns).unionByName(one)
