"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .op1_substring_dedup import op1_substring_dedup
from .op10_ngram_jaccard import op10_ngram_jaccard
from .op2_chat_format import op2_chat_format
from .op3_html_extraction import op3_html_extraction
from .op4_license_scan import op4_license_scan
from .op5_decontamination import op5_decontamination
from .op6_token_counts import op6_token_counts
from .op7_sharding import op7_sharding
from .op8_packing import op8_packing
from .op9_quality_rules import op9_quality_rules


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_html_extraction": op3_html_extraction,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_substring_dedup": oracles.OP1,
    "op2_chat_format": oracles.OP2,
    "op7_sharding": oracles.OP7,
    "op9_quality_rules": oracles.OP9,
    "op10_ngram_jaccard": oracles.OP10,
}
