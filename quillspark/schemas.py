"""Row types, modes and fixed settings of the evaluation pipelines."""

from __future__ import annotations

from pyspark.sql import types as T

# Ratios, modes and taxonomy flags that users of the pipelines know.
RATIOS = (1.0, 2.0, 4.0, 8.0)
OCR_RATIOS = (1.0, 1.5, 2.0, 4.0, 6.0, 8.0)
MODES = ("text_only", "image", "image_ratio1", "image_ratio2", "image_ratio4", "image_ratio8")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")
SYMBOLS = "()[]{},.:;="

GROUND_TRUTH = T.StructType().add("id", "string").add("code", "string")
USAGE = T.MapType(T.StringType(), T.LongType())
OCR_RESULT = (
    T.StructType().add("code_id", "string").add("ratio", "double").add("text", "string").add("error", "string").add("num_pages", "integer")
    .add("image_paths", T.ArrayType(T.StringType())).add("image_path", "string").add("model", "string").add("finish_reason", "string").add("usage", USAGE)
)
TOKENS = T.StructType().add("prompt_tokens", "long").add("completion_tokens", "long").add("total_tokens", "long")
COMPLETION_RESULT = (
    T.StructType().add("id", "string").add("gt", "string").add("output", "string").add("es", "double").add("em", "double")
    .add("compression_ratio", "double").add("resolution", "integer").add("mode", "string").add("tokens", TOKENS)
)
QA_ITEM = T.StructType().add("repo", "string").add("context", "string").add("question", "string").add("options", T.MapType(T.StringType(), T.StringType())).add("answer", "string").add("is_hard", "boolean")
CLONE_RESULT = T.StructType().add("mode", "string").add("pred", "boolean").add("label", "boolean")


def mode_name(ratio: float) -> str:
    """image_ratio1, image_ratio1.5: whole ratios have no decimals."""
    return f"image_ratio{ratio:g}"
