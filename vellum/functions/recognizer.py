"""Recognisers as plug-ins: anything that maps a batch of crops to texts and scores runs as one Arrow iterator function, loaded once a worker."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Recognizer(Protocol):
    """A model. ``ready`` tells whether it can run; ``run`` gives (text, score, error) for each crop and never raises for one bad crop."""

    def ready(self) -> bool: ...

    def run(self, crops: list[bytes]) -> list[tuple[str, float, str | None]]: ...


class Digest:
    """A stand-in without weights: the digest of a crop as its text. Deterministic, so plans and joins around a model can be tested."""

    def ready(self) -> bool:
        return True

    def run(self, crops: list[bytes]) -> list[tuple[str, float, str | None]]:
        import zlib

        return [("", 0.0, "empty_crop") if not c else (f"{zlib.crc32(c):08x}", 1.0, None) for c in crops]


def recognise(crops: DataFrame, load: Callable[[], Recognizer], column: str = "content") -> DataFrame:
    """(page_id, region_id, text, score, error) for each crop. Batches are as wide as Arrow's, across pages; an error is a value and not a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            own = [bytes(x or b"") for x in batch.column(2).to_pylist()]
            found = model.run(own) if model.ready() else [("", 0.0, "not_ready")] * len(own)
            text, score, error = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(score, pa.float64()), pa.array(error, pa.string())], ["page_id", "region_id", "text", "score", "error"])

    return crops.select("page_id", "region_id", crops[column].cast("binary").alias("content")).mapInArrow(run, "page_id long, region_id int, text string, score double, error string")


#: Codes of replies after which a request may be sent again.
TRANSIENT = (502, 503, 504)


class TransientError(Exception):
    """A reply with one of the ``TRANSIENT`` codes, or none."""


class Retrying:
    """A model whose calls are sent again after transient failures, ever later and not all at once, as long as time is left."""

    def __init__(self, model: Recognizer, attempts: int = 3, budget_s: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random):
        self.model, self.attempts, self.budget_s, self.clock, self.sleep, self.draw = model, attempts, budget_s, clock, sleep, draw

    def ready(self) -> bool:
        return self.model.ready()

    def wait_s(self, attempt: int) -> float:
        """50 ms, doubled up to four times, and up to half of that more."""
        return 0.05 * 2 ** min(attempt, 4) * (1 + self.draw() / 2)

    def run(self, crops: list[bytes]) -> list[tuple[str, float, str | None]]:
        begun = self.clock()
        for attempt in range(self.attempts):
            try:
                return self.model.run(crops)
            except TransientError:
                wait = self.wait_s(attempt)
                if attempt + 1 == self.attempts or self.clock() - begun + wait > self.budget_s:
                    break
                self.sleep(wait)
        return [("", 0.0, "transport_error")] * len(crops)


def infer_regions(images: DataFrame, models: dict[str, Callable[[], Recognizer]]) -> DataFrame:
    """(id, text, error) of (id, modality, content): each image is one region, read by the model of its modality; an unknown modality gives no text."""
    out = images.where(~F.col("modality").isin(*models) | F.col("modality").isNull()).select(F.col("id").cast("long").alias("id"), F.lit("").alias("text"), F.lit(None).cast("string").alias("error"))
    for modality, load in models.items():
        own = images.where(F.col("modality") == modality).select(F.col("id").cast("long").alias("page_id"), F.lit(0).alias("region_id"), "content")
        out = out.unionByName(recognise(own, load).select(F.col("page_id").alias("id"), "text", "error"))
    return out
