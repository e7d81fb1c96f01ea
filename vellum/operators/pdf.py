"""Text layers of PDF pages: characters to lines, quality, and how each page is to be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as t


def lines_of(characters: DataFrame) -> DataFrame:
    """Characters (doc_id, idx, ch, x0, y0, x1, y1) to lines: breaks at line ends, controls but tabs dropped, the hull of what is left, ends without white space."""
    by = Window.partitionBy("doc_id").orderBy("idx")
    breaks = F.col("ch").isin("\r", "\n")
    numbered = characters.withColumns({"breaks": breaks, "line": F.sum(breaks.cast("int")).over(by)})
    kept = numbered.where(~F.col("breaks") & ((F.ascii("ch") >= 32) | (F.col("ch") == "\t")))
    lines = kept.groupBy("doc_id", "line").agg(
        F.rtrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ch"))), lambda e: e["ch"]), "")).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return lines.where("text <> ''")


def in_pieces(pages: DataFrame, size: int) -> DataFrame:
    """Pages (doc_id, text) in pieces (doc_id, start, text) of at most that many code points, start being the place of the first. Nulls have none; an empty text is a piece."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        def ends(data):
            """Places in the bytes of a text where a piece ends, the end of the text among them."""
            found, seen = [], 0
            for at in range(0, len(data), 1 << 20):
                points = np.flatnonzero((data[at : at + (1 << 20)] & 0xC0) != 0x80) + at
                found.append(points[-seen % size :: size])
                seen += len(points)
            return np.append(np.concatenate(found)[1:], len(data))

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            large = pa.types.is_large_string(texts.type)
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
            rows, starts = np.arange(len(texts)), np.zeros(len(texts), np.int64)
            if (long := np.flatnonzero(np.diff(offsets) > size)).size:
                letters = np.frombuffer(data, np.uint8)
                cuts = {i: offsets[i] + ends(letters[offsets[i] : offsets[i + 1]]) for i in long}
                counts = np.ones(len(texts), np.int64)
                counts[long] = [len(x) for x in cuts.values()]
                rows = np.repeat(rows, counts)
                starts = (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
                offsets = np.concatenate([offsets[:1], *(cuts.get(i, offsets[i + 1 : i + 2]) for i in range(len(texts)))]).astype(offsets.dtype)
            pieces = (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(rows), pa.py_buffer(np.ascontiguousarray(offsets)), data)
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(starts), pieces], ["doc_id", "start", "text"])
            yield from (out.slice(k, 1024) for k in range(0, out.num_rows, 1024))

    return pages.where("text is not null").select("doc_id", "text").mapInArrow(cut, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, start long, text string")


def text_in_boxes(layers: DataFrame, boxes: DataFrame, held: int = 1 << 20) -> DataFrame:
    """Text of the characters whose centres lie in a box, in their order. Boxes with none have no row.

    Layers (doc_id, text, x0, y0, x1, y1) have the text of a page and, in arrays, the box of each of its code points: a page is a row, and its characters are not
    sent as rows. Long pages can come in pieces, with the place of their first character in a column ``start``. Pages and boxes (doc_id, box_id, x0, y0, x1, y1)
    are dealt out once and read page by page, a page's boxes first. Layers of one page are put together by the places of their characters. Of a page no more than
    ``held`` characters are kept, and a piece; beyond, what lies in a box is, as text once nothing can come before it, and until then as a count for each place and character.
    """
    sides = ("x0", "y0", "x1", "y1")
    b = boxes.dropna(subset=["doc_id", *sides]).select("doc_id", "box_id", *(F.col(k).alias(f"b_{k}") for k in sides))
    start = F.col("start").cast("long") if "start" in layers.columns else F.lit(0).cast("long")
    pages = layers.where("doc_id is not null and text <> ''").select("doc_id", start.alias("start"), "text", *sides)
    parts = int(layers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = b.unionByName(pages, allowMissingColumns=True).select("doc_id", "box_id", *(f"b_{k}" for k in sides), "start", "text", *sides).repartition(parts, "doc_id").sortWithinPartitions("doc_id", F.col("text").isNotNull(), "start")

    def read(batches):
        import numpy as np
        import pyarrow as pa

        def doubled(low, high):
            """Twice the centre. Nulls come as NaN, which lies in no box."""
            return np.add(*(x.astype(np.int64) if x.dtype.kind == "i" else x for x in (low, high)))

        def written(points):
            return points.astype("<u4").tobytes().decode("utf-32-le")

        def within(corners, x, y):
            places = [np.flatnonzero((x >= 2 * x0) & (x <= 2 * x1) & (y >= 2 * y0) & (y <= 2 * y1)) for x0, y0, x1, y1 in corners]
            return places[0] if len(places) == 1 else np.sort(np.concatenate(places))

        def folded(own, texts, kept, below=None):
            """Adds the characters of pieces to what is kept of each box: text of the places below that one, and counts of the others by place and character."""
            letters = np.concatenate([np.frombuffer(text.encode("utf-32-le"), "<u4") for _, text, *_ in texts])
            places = np.concatenate([np.arange(first, first + len(t[0])) for first, _, *t in texts])
            x, y = (np.concatenate([doubled(t[k], t[k + 2]) for t in texts]) for k in (2, 3))
            marks = places << 21 | letters  # a code point has 21 bits
            for key, corners in own.items():
                texts_of, old, counts = kept.setdefault(key, ([], np.zeros(0, np.int64), np.zeros(0, np.int64)))
                new, more = np.unique(marks[within(corners, x, y)], return_counts=True)
                both, at = np.unique(np.concatenate([old, new]), return_inverse=True)
                sums = np.zeros(len(both), np.int64)
                np.add.at(sums, at, np.concatenate([counts, more]))
                end = len(both) if below is None else np.searchsorted(both, below << 21)
                if end:
                    texts_of.append(written(np.repeat(both[:end] & (1 << 21) - 1, sums[:end])))
                kept[key] = texts_of, both[end:], sums[end:]

        def found(own, texts, kept):
            """Of a page: each box with the text in it."""
            if kept or len(texts) > 1:
                folded(own, texts, kept)
                yield from ((key, "".join(parts)) for key, (parts, *_) in kept.items() if parts)
                return
            _, text, *t = texts[0]
            letters, x, y = np.frombuffer(text.encode("utf-32-le"), "<u4"), doubled(t[0], t[2]), doubled(t[1], t[3])
            for key, corners in own.items():
                if len(at := within(corners, x, y)):
                    yield key, written(letters[at])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((ids, keys, pa.string()))], ["doc_id", "box_id", "text"])

        doc, own, texts, kept, waiting, ids, keys = None, {}, [], {}, 0, None, None
        for batch in batches:
            ids, keys, rows = batch.schema.field(0).type, batch.schema.field(1).type, []
            arrays = [(a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)) for a in (batch.column(k) for k in range(8, 12))]
            for i, (d, key, *corners, first, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)))):
                if d != doc:
                    if own and texts:
                        rows += ((doc, *r) for r in found(own, texts, kept))
                    doc, own, texts, kept, waiting = d, {}, [], {}, 0
                if text is None:
                    own.setdefault(key, []).append(corners)
                elif own:
                    if waiting > held:
                        folded(own, texts, kept, first)
                        texts, waiting = [], 0
                    texts.append((first, text, *(values[offsets[i] : offsets[i + 1]] for offsets, values in arrays)))
                    waiting += len(text)
            yield batch_of(rows)
        if own and texts:
            yield batch_of([(doc, *r) for r in found(own, texts, kept)])

    kinds = layers.schema["doc_id"].dataType.simpleString(), boxes.schema["box_id"].dataType.simpleString()
    return dealt.mapInArrow(read, f"doc_id {kinds[0]}, box_id {kinds[1]}, text string")


def layer_quality(chars: Column, rotation: Column, replaced: Column, controls: Column, lines: Column) -> Column:
    """F8: absent, rejected or trusted; the order of the rules counts."""
    return (
        F.when(chars == 0, "absent").when(rotation != 0, "rejected").when(chars < 10, "absent")
        .when((replaced * 20 > chars) | (controls * 10 > chars), "rejected").when(lines == 0, "absent").otherwise("trusted")
    )


def plausible(text: Column, width: Column, height: Column) -> Column:
    """whether native text can stand in a box of that many points."""
    n = F.char_length(text)
    sized = (width > 0) & (height > 0)
    odd = sized & ((n * 60 < width) | (n > width))
    return (n > 0) & ~(t.replacement_count(text) * 20 > n) & ~(t.unprintable_count(text) * 10 > n) & ~odd


def resolve_mode(mode: Column, quality: Column, layout: Column, images: Column) -> tuple[Column, Column]:
    """(how the page is read, whether it must be drawn)."""
    good = quality == "trusted"
    resolved = F.when(mode == "auto", F.when(good, "geometric").otherwise("ocr")).otherwise(mode)
    drawn = F.when(mode == "geometric", layout).when(mode == "auto", ~good | layout).otherwise(True)
    return resolved, drawn | images


def fill_from_layer(lines: DataFrame) -> DataFrame:
    """Results of a page from its text layer: rounded points, full confidence."""
    return lines.select("doc_id", "line", "text", F.lit(1.0).alias("confidence"), F.lit("pdf").alias("source"), *(F.round(k).cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")))


def verify_with_layer(results: DataFrame, native: DataFrame) -> DataFrame:
    """Results (doc_id, box_id, text, box) take the native text of their box where it is plausible."""
    n = native.select("doc_id", "box_id", F.col("text").alias("native"))
    good = F.coalesce(plausible(F.col("native"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.lit(False))
    out = results.join(n, ["doc_id", "box_id"], "left").withColumn("good", good)
    return out.select("doc_id", "box_id", F.when(F.col("good"), F.col("native")).otherwise(F.col("text")).alias("text"), F.when(F.col("good"), "pdf").otherwise("ocr").alias("source"))
