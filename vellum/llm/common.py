"""What the operators of this subpackage share: bounded slices of Arrow batches, tables in the shared folder, hashes."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into arrays at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding up to ``limit`` bytes of ``column``; one longer text is a run by itself."""
    import numpy as np

    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def map_text(frame: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``work`` over bounded slices of the rows; no shuffle."""

    def run(batches):
        for part in slices(batches, column, limit):
            if (out := work(part)) is not None:
                yield out

    return frame.mapInArrow(run, schema)


def texts(part: pa.RecordBatch, column: str) -> list[str | None]:
    return part.column(part.schema.get_field_index(column)).to_pylist()


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % modulus


def crc_of(value) -> int:
    return zlib.crc32(str("null" if value is None else value).encode())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of
    its own; on any other master that is an error, for executors would write to disks that the others don't see."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share; it isn't set, and the master is {spark.sparkContext.master}")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders that this process wrote and has not deleted.
_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder, which ``clean`` deletes."""
    _written.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows once into the shared folder and read them back: what follows doesn't compute them again,
    and a lost executor loses none of them."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the intermediate folders from number ``since`` on but the last ``keep``: all of them by default, which is safe
    once results have been written, as results are lazy and read these folders."""
    for path in _written[since : len(_written) - keep]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


def written() -> int:
    """How many intermediate folders there are now; ``clean`` takes the number."""
    return len(_written)


def load_tokens(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
