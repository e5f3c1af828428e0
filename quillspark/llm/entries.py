"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillspark.llm import decontaminate, html_extract, lm_scoring, media, mixing, pii, quality, secrets, simhash, substring_dedup


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_suffix_tree": lm_scoring.op1_query,
        "op2_html_tree": html_extract.op2_query,
        "op3_template_leaks": decontaminate.op3_query,
        "op4_secret_markov": secrets.op4_query,
        "op5_media_png": media.op5_query,
        "op6_substring_dedup": substring_dedup.op6_query,
        "op7_quality_pu": quality.op7_query,
        "op8_source_mixing": mixing.op8_query,
        "op9_simhash_tiles": simhash.op9_query,
        "op10_pii_offsets": pii.op10_query,
    }


def oracle_sql() -> dict:
    return {"op6_substring_dedup": substring_dedup.OP6_SQL, "op8_source_mixing": mixing.OP8_SQL}
