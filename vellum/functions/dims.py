"""Constant dimension tables. They have a fixed number of rows, so they are joined by broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout classes in the order of their numbers.
LABELS = (
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title", "footer", "footer_image",
    "footnote", "formula_number", "header", "header_image", "image", "inline_formula", "number", "paragraph_title", "reference", "reference_content",
    "seal", "table", "text", "vertical_text", "vision_footnote",
)
SUPPLEMENTARY, SUPPLEMENTARY_LABEL = -1, "SupplementaryRegion"
TOP, BOTTOM = (12, 13), (8, 9, 10, 18, 19, 24)
FORMULAS, TABLES, SKIPPED = (5, 15), (21,), (3, 9, 13, 14, 20)
#: Classes whose thresholds differ from 400 and 200 thousandths.
TRUST = {21: 600, 5: 550, 15: 550, 14: 500, 3: 500, 20: 500}
VERIFY = {21: 250, 5: 300, 15: 300, 14: 300, 3: 300, 20: 300}
PRIORITY = {21: 5, 5: 4, 15: 3, 3: 1, 9: 1, 13: 1, 14: 1, 20: 1}
#: Error codes with their HTTP and gRPC status.
ERRORS = (
    ("MISSING_IMAGE", 400, 3), ("MISSING_PDF", 400, 3), ("MISSING_FILE", 400, 3), ("MISSING_HEADER", 400, 3), ("INVALID_HEADER", 400, 3), ("INVALID_JSON", 400, 3),
    ("INVALID_MULTIPART", 400, 3), ("INVALID_DPI", 400, 3), ("INVALID_DIMENSIONS", 400, 3), ("INVALID_PARAMETER", 400, 3), ("BASE64_DECODE_FAILED", 400, 3), ("IMAGE_DECODE_FAILED", 400, 3),
    ("DIMENSIONS_TOO_LARGE", 400, 3), ("BODY_SIZE_MISMATCH", 400, 3), ("EMPTY_BODY", 400, 3), ("EMPTY_BATCH", 400, 3), ("BATCH_TOO_LARGE", 400, 3), ("EMPTY_PDF", 400, 3),
    ("PDF_TOO_LARGE", 400, 3), ("PDF_RENDER_FAILED", 400, 3), ("AUTOROTATE_DISABLED", 400, 3), ("LAYOUT_DISABLED", 400, 3), ("NOT_READY", 503, 14), ("SERVER_BUSY", 503, 8),
    ("PDF_NOT_AVAILABLE", 501, 12), ("INFERENCE_ERROR", 500, 13), ("PAGE_DECODE_FAILED", 500, 13), ("INFERENCE_TIMEOUT", 504, 4),
)


def bucket_of(class_id: int) -> int:
    return 0 if class_id in TOP else 2 if class_id in BOTTOM else 1


def destination_of(class_id: int) -> str:
    return "table" if class_id in TABLES else "formula" if class_id in FORMULAS else "skip" if class_id in SKIPPED else "text"


def class_rows() -> list[tuple]:
    """(class_id, label, bucket, destination, trust_milli, verify_milli, priority)."""
    return [(c, SUPPLEMENTARY_LABEL if c < 0 else LABELS[c], bucket_of(c), destination_of(c), TRUST.get(c, 400), VERIFY.get(c, 200), PRIORITY.get(c, 2)) for c in range(-1, len(LABELS))]


CLASS_COLUMNS = "class_id int, label string, bucket int, destination string, trust_milli int, verify_milli int, priority int"


def layout_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(class_rows(), CLASS_COLUMNS)


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERRORS), "code string, http_status int, grpc_status int")


def with_class(frame: DataFrame, *columns: str) -> DataFrame:
    """Adds columns of the class dimension by ``class_id``; 26 rows are broadcast."""
    classes = layout_classes(frame.sparkSession).select("class_id", *columns)
    return frame.join(F.broadcast(classes), "class_id", "left")


def tier(score: Column) -> Column:
    """Needs trust_milli and verify_milli; score in thousandths."""
    return F.when(score >= F.col("trust_milli"), "trust").when(score >= F.col("verify_milli"), "verify").otherwise("fallback")


def values_sql(rows: list[tuple], name: str, columns: str) -> str:
    """The rows as a common table expression, for the SQL that queries are held against."""
    text = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({', '.join(c.split()[0] for c in columns.split(', '))}) as (values {text})"


CLASSES_SQL = values_sql(class_rows(), "classes", CLASS_COLUMNS)
ERRORS_SQL = values_sql(list(ERRORS), "errors", "code string, http_status int, grpc_status int")


# Models by name with their recogniser, dictionary and detector; those of a language have no detector of their own.
MODELS = (
    ("medium", "models/rec.onnx", "models/keys.txt", "models/det.onnx", False), ("small", "models/rec_small.onnx", "models/keys.txt", "models/det_small.onnx", False),
    ("tiny", "models/rec_tiny.onnx", "models/keys_tiny.txt", "models/det_tiny.onnx", False), ("arabic", "models/rec/arabic/rec.onnx", "models/rec/arabic/dict.txt", "models/det.onnx", True),
    ("eslav", "models/rec/eslav/rec.onnx", "models/rec/eslav/dict.txt", "models/det.onnx", True), ("korean", "models/rec/korean/rec.onnx", "models/rec/korean/dict.txt", "models/det.onnx", True),
    ("thai", "models/rec/thai/rec.onnx", "models/rec/thai/dict.txt", "models/det.onnx", True), ("greek", "models/rec/greek/rec.onnx", "models/rec/greek/dict.txt", "models/det.onnx", True),
)
DEFAULT_MODEL = "tiny"


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "name string, rec string, dict string, det string, of_language boolean")


def with_model(requests: DataFrame) -> DataFrame:
    """Name, rec, dict and det for a wanted model, else a language, else the default; paths that a request gives itself (own_rec, own_dict, own_det) come first. ``fault`` tells of unknown models."""
    names, spoken = [m[0] for m in MODELS], [m[0] for m in MODELS if m[4]]
    asked = F.nullif("model", F.lit(""))
    name = F.when(asked.isin(*names), asked).when(asked.isNull() & F.col("lang").isin(*spoken), F.col("lang")).otherwise(DEFAULT_MODEL)
    named = requests.withColumns({"name": name, "fault": F.when(asked.isNotNull() & ~asked.isin(*names), "unknown_model")})
    paths = [F.coalesce(F.nullif(f"own_{k}", F.lit("")), F.col(k)).alias(k) for k in ("rec", "dict", "det")]
    return named.join(F.broadcast(models(requests.sparkSession)), "name").select("id", "name", *paths, "fault")
