"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with the records of about ``frame_bytes``, and a last, skippable frame with the seek
table of the Zstandard seekable format: compressed and decompressed size of each frame, their number and the closing magic number. Any
Zstandard tool reads a bundle from front to end; with the seek table a reader fetches and decompresses one frame. The index that
writing returns, and leaves beside the bundles, maps record identifiers to file, frame and offset in the decompressed frame. Reading
goes by the index alone: runs of frames are dealt to as many tasks as there are bytes for, each task takes the places of its frames from the
seek table, and takes from a frame the records that the index names, each at its offset. A revisit is held against the response that it refers to.

Of records with equal payloads of ``min_revisit`` bytes or more, that with the largest id is a response, and the others revisit it. Payloads
are compared by digest and length, which are computed before the shuffle.

Each task writes files under names of its own attempt, in the folder that all executors share; the index is written once and names
only files of attempts that succeeded, so lost executors and repeated tasks leave stray files at worst, never wrong records.

Defined results: a null payload is empty; rows that repeat an id with an equal payload are all responses if the id is the largest; a row with
a null id revisits others but nothing revisits it, and it reads back as null; extra columns are ignored; an empty table makes no file and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise, scratch, slices, texts

# Magic numbers of the Zstandard seekable format, the prefix of record identifiers and the profile of revisits.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PREFIX = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Frames in a row that one task reads, and bytes of records that a task reads at the mean.
RUN, TASK_BYTES = 8, 64 << 20


def mark_revisits(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", min_revisit: int = 1000) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the id of the response for revisits, else null."""
    payload = F.coalesce(pages[payload_column], F.lit(""))
    rows = pages.select(pages[id_column].alias("id"), pages[url_column].alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    large = F.col("n") >= min_revisit
    first = materialise(rows.where(large).groupBy("digest", "n").agg(F.max("id").alias("response"), F.count("*").alias("c")).where("c > 1 and response is not null").select("digest", "n", "response"), "responses")
    joined = rows.join(first, ["digest", "n"], "left")
    return joined.select("id", "url", "payload", "digest", F.when(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def identifier(value) -> str:
    return f"<{PREFIX}{'' if value is None else quote(str(value), safe='')}>"


def from_identifier(text: str) -> str | None:
    return unquote(text.strip("<>")[len(PREFIX) :]) or None


def record(value, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of a response, or of a revisit if ``refers_to`` isn't None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {identifier(value)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {identifier(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def information(date: str) -> bytes:
    body = b"software: vellum\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{PREFIX}info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def record_at(frame: bytes, at: int) -> tuple[dict, bytes]:
    """Headers and block of the record at that offset of a decompressed frame."""
    end = frame.index(b"\r\n\r\n", at) + 4
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in frame[at:end].decode().split("\r\n")[1:] if x)}
    return headers, frame[end : end + int(headers["content-length"])]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame of an open bundle."""
    size = file.size()
    n, descriptor, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    each = 12 if descriptor & 0x80 else 8
    raw, place, out = file.read_at(n * each, size - 9 - n * each), 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", raw, k * each)
        out.append((place, packed, plain))
        place += packed
    return out


def file_system(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


class Bundle:
    """Writes records into one bundle."""

    def __init__(self, system, path: str, frame_bytes: int, date: str, level: int):
        import zstandard

        self.file, self.frame_bytes = system.open_output_stream(path, compression=None), frame_bytes
        self.compressor, self.sizes, self.held, self.size, self.written = zstandard.ZstdCompressor(level=level), [], [], 0, 0
        self.add(information(date))
        self.flush()

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) where the record goes."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        at = (len(self.sizes), self.size)
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.file.write(packed)
            self.sizes.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.file.write(seek_table(self.sizes))
        self.file.close()


@dataclass(frozen=True)
class Options:
    frame_bytes: int = 1 << 20
    bundle_bytes: int = 256 << 20
    level: int = 3
    date: str = "2000-01-01T00:00:00Z"


def write(marked: DataFrame, folder: str | None = None, options: Options = Options()) -> DataFrame:
    """Writes the rows of ``mark_revisits`` and returns the index: (id, record_id, file, frame, offset, length). It is kept as Parquet
    in the folder ``index`` beside the bundles; without ``folder`` all of it is intermediate."""
    folder = folder or scratch(marked.sparkSession, "warc")
    kind = marked.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        stem, number, bundle = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None
        for part in slices(batches, "payload"):
            rows = zip(part.column(0).to_pylist(), *(texts(part, x) for x in ("url", "payload", "digest", "refers_to")))
            found = []
            for value, url, payload, digest, refers_to in rows:
                if bundle is not None and bundle.written > options.bundle_bytes:
                    bundle.close()
                    bundle, number = None, number + 1
                if bundle is None:
                    name = f"{stem}-{number:04d}.warc.zst"
                    bundle = Bundle(system, f"{path}/{name}", options.frame_bytes, options.date, options.level)
                data = record(value, url, payload.encode(), digest, refers_to, options.date)
                found.append((identifier(value), f"{folder}/{name}", *bundle.add(data), len(data)))
            columns = list(zip(*found))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "record_id", "file", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    index = marked.mapInArrow(run, f"id {kind}, record_id string, file string, frame int, offset long, length long")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return marked.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read_record(file: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """Headers and block of one record, by the index: one frame is read and decompressed."""
    import zstandard

    system, path = file_system(file)
    with system.open_input_file(path) as opened:
        place, packed, plain = read_seek_table(opened)[frame]
        data = zstandard.ZstdDecompressor().decompress(opened.read_at(packed, place), max_output_size=plain)
    return record_at(data, offset)


def visit(index: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over the (headers, block) pairs of each frame, those records only that the index, or a part of it, names: frames are
    found by the seek table, records at their offsets."""
    spark = index.sparkSession
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    # Offsets of a frame are gathered before the shuffle: the task that wrote them has them all, and a frame is bounded.
    frames = index.groupBy("file", "frame").agg(F.collect_list("offset").alias("offsets"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    dealt = frames.withColumn("run", F.expr(f"frame div {RUN}")).repartition(parts, "file", "run").sortWithinPartitions("file", "frame").select("file", "frame", "offsets")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        rows = (r for part in batches for r in zip(*(part.column(k).to_pylist() for k in range(3))))
        for name, own in itertools.groupby(rows, key=lambda r: r[0]):
            system, path = file_system(name)
            with system.open_input_file(path) as opened:
                places = read_seek_table(opened)
                for _, frame, offsets in own:
                    place, packed, plain = places[frame]
                    data = unpack.decompress(opened.read_at(packed, place), max_output_size=plain)
                    yield work([record_at(data, at) for at in sorted(offsets)])

    return dealt.mapInArrow(run, schema)


def fetch(index: DataFrame) -> DataFrame:
    """(record_id, headers, block) of each record that the index names."""

    def work(found):
        columns = [[h["warc-record-id"] for h, _ in found], [list(h.items()) for h, _ in found], [b for _, b in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()))], ["record_id", "headers", "block"])

    return visit(index, work, "record_id string, headers map<string,string>, block binary")


def read(index: DataFrame, id_type: str) -> DataFrame:
    """What the index leads to: (id, payload_bytes, payload_digest, record_type, refers_to) of each record. Raises if a response isn't
    what its digest says, or a revisit's response has another payload or isn't there."""

    def work(found):
        columns = list(zip(*(describe(h, b) for h, b in found)))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    found = materialise(visit(index, work, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string"), "warc-read")
    check_revisits(found)
    return found.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def check_revisits(found: DataFrame) -> None:
    """Raises if a revisit says another size or digest than the response it refers to; of its copies one row is compared."""
    said = found.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("id"), "payload_digest", "payload_bytes").agg(F.count("*").alias("n"))
    kept = found.where("record_type = 'response'").select("id", "payload_digest", "payload_bytes")
    if wrong := said.join(kept, ["id", "payload_digest", "payload_bytes"], "left_anti").select("id").head(3):
        raise ValueError(f"revisits don't agree with the responses they refer to: {[r['id'] for r in wrong]}")


def describe(headers: dict, block: bytes) -> tuple:
    """(id, bytes, digest, type, refers to) of a response or revisit; raises if a response isn't what its digest says."""
    kind = headers["warc-type"]
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} isn't what its headers say")
    refers = headers.get("warc-refers-to")
    return from_identifier(headers["warc-record-id"]), size, digest, kind, from_identifier(refers) if refers else None


def round_trip(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", min_revisit: int = 1000, folder: str | None = None, options: Options = Options()) -> DataFrame:
    """Writes all rows into bundles and reads them back by the index. With ``folder`` bundles and index stay there for the caller."""
    kind = pages.schema[id_column].dataType.simpleString()
    index = write(mark_revisits(pages, id_column, payload_column, url_column, min_revisit), folder, options)
    return read(index, kind).withColumnRenamed("id", id_column)
