"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

A rotation is learned on a bounded sample (``sample_rows``): from a random one on, it alternates between the signs of the rotated vectors
and the rotation that brings vectors closest to their signs. Signs of the rotated vectors are binary codes. Vectors are not centred, so a
bit differs as often as the angle of a pair has it; where vectors share a direction, buckets grow, and links are still found.
The code is cut into substrings, one table for each. Vectors meet where a substring is equal, and a pair is judged in the first table in
which it meets. There vectors are compared in single precision, and what comes near the limit is reranked in double precision. The width
of the substrings follows the number of vectors, so tables have few vectors a bucket, and the number of tables follows the width, so that a
pair at the limit meets with the same chance (``RECALL``) at any size and dimension. Vectors of different lengths have rotations and buckets of their own.

Exact copies (equal components) are one row in the tables, with its number of copies, and codes are computed once for each different vector.
Buckets are dealt as blocks: a large one becomes tiles of two blocks, and only its rows are sent more than once. Tasks return counts by
vector and a spanning forest of the links, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component. Vectors of
different lengths never link. A row with a null id links with nothing and has a null component. Rows that repeat an id count as vectors of their own
in ``n_links``; different vectors under one id are one node. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise
from vellum.llm.components import Forest, components

COSINE = 0.95
#: Directions that a rotation is learned over, at most.
AXES = 256
#: Share of the pairs at the least cosine that meet in some table.
RECALL = 0.99
#: Rows of a bucket in a block.
BLOCK = 2048
#: Pairs held at a time.
PAIRS = 4 << 20
#: Large buckets that are broadcast at most; beyond it the join is Spark's to choose.
KNOWN = 200_000


def learn_rotation(vectors: np.ndarray, bits: int, rounds: int = 30, seed: int = 42) -> np.ndarray:
    """projection: signs of x @ projection are the code. Vectors are not centred: that would widen angles where they share a direction.

    More bits than directions are taken from several rotations."""
    size = vectors.shape[1]
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    while sum(x.shape[1] for x in out) < bits:
        # All directions or, of very many, a random subspace: it keeps the angles of all pairs, those of principal axes only.
        axes = np.linalg.qr(rng.normal(size=(size, min(size, AXES))))[0]
        rotation = np.eye(axes.shape[1])
        projected = vectors @ axes
        for _ in range(rounds if len(vectors) else 0):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            rotation = (left @ right).T
        out.append(axes @ rotation)
    return np.concatenate(out, axis=1)[:, :bits]


def encode(vectors: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """Substrings of the codes, one column for each table; bit k of a substring from its column k."""
    signs = (vectors @ projection >= 0).reshape(len(vectors), -1, width)
    return signs @ (1 << np.arange(width, dtype=np.int64))


def unit(rows: list, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows in double precision, and which rows are usable."""
    good, out = np.zeros(len(rows), bool), []
    for i, row in enumerate(rows):
        if row is None or len(row) == 0 or size is not None and len(row) != size or any(x is None for x in row):
            continue
        x = np.asarray(row, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            continue
        x = x / top
        out.append(x / np.sqrt(x @ x))
        good[i] = True
    return np.array(out).reshape(len(out), -1), good


def clean_unit(column, size: int) -> np.ndarray:
    """Unit vectors of a column without nulls whose rows are all usable and of that size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy().astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plan_width(n: int) -> int:
    """Bits of a substring for n vectors: a bucket has about 1024 of them at any n."""
    return max(8, int(np.ceil(np.log2(max(1, n) / 1024))))


def table_count(width: int, cosine: float) -> int:
    """Tables in which a pair at that cosine meets at least once with a chance of ``RECALL``, at any width."""
    meet = (1 - min(1.0, np.arccos(min(1.0, cosine)) / np.pi)) ** width
    return 1 if meet >= RECALL else int(np.ceil(np.log(1 - RECALL) / np.log1p(-meet)))


class Rotations:
    """A projection for each length of vectors; lengths that the sample doesn't have get one that isn't learned, the same everywhere."""

    def __init__(self, sample: dict[int, np.ndarray], bits: int):
        self.bits, self.learned = bits, {size: learn_rotation(x, bits) for size, x in sample.items()}

    def of(self, size: int) -> np.ndarray:
        return self.learned[size] if size in self.learned else plain_rotation(size, self.bits)


@lru_cache(64)
def plain_rotation(size: int, bits: int) -> np.ndarray:
    return learn_rotation(np.zeros((0, size)), bits)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, sample_rows: int = 20_000) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_column].alias("id"), vectors[vector_column].alias("v"))
    kind, element = rows.schema["id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    keyed = rows.select("id", "v", F.coalesce(F.col("v").isNotNull() & F.col("id").isNotNull() & usable, F.lit(False)).alias("usable"))

    # One row for each different vector: equal components mean equal text of the array.
    different = materialise(keyed.where("usable").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n = different.count()
    if not n:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = plan_width(n)
    tables = table_count(width, cosine)
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30)
    sample: dict[int, list] = {}
    for r in different.where(place < min(1.0, sample_rows / n)).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    rotations = spark.sparkContext.broadcast(Rotations({size: unit(x)[0] for size, x in sample.items()}, tables * width))

    def code_rows(batches):
        for part in batches:
            sizes = part.column(0).value_lengths().to_numpy()
            codes = np.zeros((len(sizes), tables), np.int32)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                codes[own] = encode(clean_unit(part.column(0).take(pa.array(own)), size), rotations.value.of(int(size)), width)
            held = pa.array([x.tobytes() for x in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, held, pa.array(list(codes), pa.list_(pa.int32()))], ["v", "rep", "copies", "code", "b"])

    coded = materialise(different.select("v", "rep", "copies").mapInArrow(code_rows, f"v {element}, rep {kind}, copies long, code binary, b array<int>"), "codes")
    placed = coded.select("v", "rep", "copies", "code", F.size("v").alias("s"), F.posexplode("b").alias("t", "b"))
    # Tiles: a row of block own meets blocks from its own on. Only large buckets have blocks.
    large = placed.groupBy("s", "t", "b").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    large = materialise(large.select("s", "t", "b", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "large")
    known = large.limit(KNOWN + 1).count()
    if known:
        placed = placed.join(F.broadcast(large) if known <= KNOWN else large, ["s", "t", "b"], "left").withColumn("own", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
        first = F.transform(F.sequence(F.col("own"), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.struct(F.col("own").alias("h"), x.alias("g"), F.lit(0).alias("role")))
        again = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda x: F.struct(x.alias("h"), F.col("own").alias("g"), F.lit(1).alias("role")))).otherwise(F.slice(first, 1, 0))
        dealt = placed.select("v", "rep", "copies", "code", "s", "t", "b", F.explode(F.concat(first, again)).alias("at")).select("v", "rep", "copies", "code", "s", "t", "b", "at.h", "at.g", "at.role")
    else:
        dealt = placed.select("v", "rep", "copies", "code", "s", "t", "b", *(F.lit(0).alias(x) for x in ("h", "g", "role")))

    def join(batches):
        held = [pa.Table.from_batches([b]) for b in batches]
        whole = pa.concat_tables(held) if held else None
        if whole is None or not whole.num_rows:
            return
        ids, number = np.unique(whole.column("rep").to_numpy(), return_inverse=True)
        counts, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        sizes = whole.column("s").to_numpy()
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            meet_all(whole.take(pa.array(own)), int(size), tables, cosine, number[own], counts, forest)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"rep": pa.array(ids[some]), "root": pa.array(ids[forest.root[some]]), "n": pa.array(counts[some])})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // 40_000))
    met = materialise(dealt.repartition(parts, "s", "t", "b", "h", "g").mapInArrow(join, f"rep {kind}, root {kind}, n long"), "met")
    roots = components(met.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    sums = met.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = different.select("v", "rep", "copies").join(sums, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    classes = materialise(classes.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    out = keyed.join(classes.withColumn("usable", F.lit(True)), ["v", "usable"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def meet_all(rows: pa.Table, size: int, tables: int, cosine: float, number: np.ndarray, counts: np.ndarray, forest: Forest) -> None:
    """Adds the links among rows of one length of vectors, cell by cell, to the counts and the forest; ``number`` is that of a row's vector."""
    x = clean_unit(rows.column("v"), size)
    short = x.astype(np.float32)
    copies = rows.column("copies").to_numpy()
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int32).reshape(-1, tables)
    t, b, h, g, role = (rows.column(k).to_numpy() for k in ("t", "b", "h", "g", "role"))
    order = np.lexsort((role, g, h, b, t))
    keys = np.stack([k[order] for k in (t, b, h, g)])
    edges = np.append(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])), len(order))

    def meet(left, right, same: bool, table: int):
        at_once = max(1, PAIRS // max(1, len(right)))
        for i in range(0, len(left), at_once):
            own = left[i : i + at_once]
            # Single precision errs by far less than the margin.
            p, q = np.nonzero(short[own] @ short[right].T >= cosine - 1e-4)
            if same:
                p, q = p[p + i < q], q[p + i < q]
            for k in range(0, len(p), 1 << 17):
                a, c = own[p[k : k + (1 << 17)]], right[q[k : k + (1 << 17)]]
                linked = np.einsum("ij,ij->i", x[a], x[c]) >= cosine
                # Judged before if they met in an earlier table.
                linked &= (code[a, :table] != code[c, :table]).all(axis=1)
                a, c = a[linked], c[linked]
                np.add.at(counts, number[a], copies[c])
                np.add.at(counts, number[c], copies[a])
                forest.link(number[a], number[c])

    for i, j in zip(edges[:-1], edges[1:]):
        own = order[i:j]
        home, other = own[role[own] == 0], own[role[own] == 1]
        if len(home) and h[home[0]] == g[home[0]]:
            meet(home, home, True, int(t[home[0]]))
        elif len(home) and len(other):
            meet(home, other, False, int(t[home[0]]))
