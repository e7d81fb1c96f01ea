"""Scans of files: images, raw pixels and PDF documents, a row for each file, content and all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of the formats.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "webp": "52494646", "bmp": "424D", "tiff": "49492A00", "pdf": "255044462D"}


def kind_of(content: Column) -> Column:
    """The format that the first bytes tell, or null."""
    head, out = F.hex(F.substring(content, 1, 12)), F.lit(None).cast("string")
    for name, start in SIGNATURES.items():
        known = head.startswith(start)
        out = F.when(known & (F.substring(head, 17, 8) == "57454250") if name == "webp" else known, name).otherwise(out)
    return out


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modified, length, content, kind) of the files below a path; content is only read where it is used, and Spark leaves empty files out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content", kind_of(F.col("content")).alias("kind"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files that start like an image."""
    return files(spark, path).where("kind <> 'pdf'")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that start like a PDF document."""
    return files(spark, path).where("kind = 'pdf'")


def pixel_error(length: Column, width: Column, height: Column, channels: Column, max_side: int = 16384) -> Column:
    """The code of a raw body that its sizes don't fit, or null."""
    odd = (width < 1) | (height < 1) | ~channels.isin(1, 3)
    size = width.cast("long") * height * channels
    return F.when(odd, "INVALID_DIMENSIONS").when(F.greatest(width, height) > max_side, "DIMENSIONS_TOO_LARGE").when(length == 0, "EMPTY_BODY").when(length != size, "BODY_SIZE_MISMATCH")


def pixels(spark: SparkSession, path: str, width: int, height: int, channels: int) -> DataFrame:
    """Raw bodies of one size, with what is wrong with them."""
    return files(spark, path).withColumn("error", pixel_error(F.col("length"), F.lit(width), F.lit(height), F.lit(channels))).drop("kind")
