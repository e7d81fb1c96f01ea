"""Decoding of model outputs: sequences of symbols with scores, as arrays in one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as t


def argmax(row: Column) -> Column:
    """Place of the largest value, counted from 0; the first of equals."""
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def softmax_confidence(row: Column) -> Column:
    """Probability of the largest value."""
    top = F.array_max(row)
    return 1.0 / F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top.cast("double")))


def orientation(scores: Column, margin: float = 0.25) -> Column:
    """Rotation of a page by four scores; 0 if the best two are closer than the margin."""
    ordered = F.sort_array(scores, asc=False)
    return F.when(F.element_at(ordered, 1) - F.element_at(ordered, 2) < margin, 0).otherwise(argmax(scores) * 90).cast("int")


def flipped(upright: Column, turned: Column, threshold: float) -> Column:
    """Whether a line stands on its head."""
    return (turned > upright) & (turned > threshold)


def ctc_collapse(steps: DataFrame, blank: int = 0) -> DataFrame:
    """Steps (seq_id, step, symbol, score) to text: a symbol counts where it isn't blank and not the one before; its mean score."""
    by = Window.partitionBy("seq_id").orderBy("step")
    before = F.lag("symbol").over(by)
    marked = steps.withColumn("kept", (F.col("symbol") != blank) & (before.isNull() | (before != F.col("symbol"))))
    grouped = marked.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("step", "symbol")))).alias("a"), F.avg(F.when(F.col("kept"), F.col("score"))).alias("score"))
    return grouped.select("seq_id", F.transform("a", lambda e: e["symbol"]).alias("symbols"), F.coalesce("score", F.lit(0.0)).alias("score"))


def structure_tokens(symbols: Column, start: int, stop: int) -> Column:
    """Symbols up to the first stop beyond the first step, without starts and stops."""
    cut = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(symbols))), F.size(symbols), lambda s, i: F.when((F.get(symbols, i - 1) == stop) & (i - 1 < s), i - 1).otherwise(s))
    return F.filter(F.slice(symbols, 1, cut), lambda x: (x != start) & (x != stop))


def structure_score(symbols: Column, scores: Column, start: int, stop: int) -> Column:
    """Mean score of the symbols that ``structure_tokens`` keeps; 0 if it keeps none."""
    paired = F.arrays_zip(symbols.alias("symbol"), scores.alias("score"))
    at = F.array_position(F.slice(symbols, 2, F.greatest(F.size(symbols) - 1, F.lit(0))), stop)
    kept = F.filter(F.slice(paired, 1, F.when(at > 0, at.cast("int")).otherwise(F.size(symbols))), lambda x: (x["symbol"] != start) & (x["symbol"] != stop))
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["score"].cast("double"))
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0)


# Bytes that byte-level tokens write as themselves; the others are written as characters from U+0100 on.
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level tokens."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_texts(ids: DataFrame, vocabulary: DataFrame, stop: int, specials: tuple[int, ...] = ()) -> DataFrame:
    """(seq_id, ids array) and (id, token) to texts: up to the stop, without specials and unknown ids, byte-level characters as their bytes, malformed
    bytes as U+FFFD, without markers of frames and white space at the ends."""
    cut = F.array_position("ids", stop)
    steps = ids.select("seq_id", F.posexplode(F.when(cut > 0, F.slice("ids", 1, (cut - 1).cast("int"))).otherwise(F.col("ids"))).alias("pos", "id"))
    found = steps.where(~F.col("id").isin(*specials)) if specials else steps
    parts = found.join(vocabulary.select("id", "token"), "id").groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("a"))
    raw = ids.select("seq_id").join(parts.select("seq_id", F.array_join(F.transform("a", lambda e: e["token"]), "").alias("raw")), "seq_id", "left")
    own = byte_alphabet()

    def to_bytes(texts):
        return texts.map(lambda x: b"".join(bytes((own[c],)) if c in own else c.encode("utf-8", "surrogatepass") for c in x or ""))

    import pandas as pd

    to_bytes.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return raw.select("seq_id", t.frame_stripped(t.repaired_utf8(F.pandas_udf(to_bytes, "binary")(F.coalesce("raw", F.lit(""))))).alias("text"))


def scaled_quads(quads: Column, across: Column, down: Column) -> Column:
    """Corners of cells, even places times the one factor and odd places times the other, cut to integers."""
    return F.transform(quads, lambda v, i: F.when(i % 2 == 0, v * across).otherwise(v * down).cast("int"))
