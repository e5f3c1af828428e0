"""Registered queries: name to Spark function and to oracle SQL."""

from __future__ import annotations

from quillspark.plans import layout_queries, score_queries, text_queries

FLAGSHIP = "ocr_cer_by_ratio"
QUERIES: dict = text_queries.QUERIES | score_queries.QUERIES | layout_queries.QUERIES
ORACLES: dict = text_queries.ORACLES | score_queries.ORACLES | layout_queries.ORACLES
