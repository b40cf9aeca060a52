"""The queries of this subpackage, by name, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillspark.llm import align, bpe, decontaminate, divergence, lm_score, pipeline, quality, secrets, simhash, suffixes, toxicity, urls, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1,
        "op2_secret_scans": secrets.op2,
        "op3_suffix_dedup": suffixes.op3,
        "op4_simhash": simhash.op4,
        "op5_quality_rules": quality.op5,
        "op6_lm_scoring": lm_score.op6,
        "op7_toxicity": toxicity.op7,
        "op8_url_filters": urls.op8,
        "op9_token_counts": bpe.op9,
        "op10_bpe": bpe.op10,
        "op11_source_divergence": divergence.op11,
        "op12_tokenizer_alignment": align.op12,
        "op13_html_extraction": wrappers.op13,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_lm_scoring": lm_score.OP6_SQL, "op8_url_filters": urls.OP8_SQL}
