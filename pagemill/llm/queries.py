"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import quality_rules, resampling
from pagemill.llm.chat_format import op10_chat_format
from pagemill.llm.decontamination import op3_decontamination
from pagemill.llm.fingerprints import op12_fingerprints
from pagemill.llm.html_extraction import op9_html_extraction
from pagemill.llm.language_id import op7_language_id
from pagemill.llm.near_duplicates import op2_ngram_jaccard
from pagemill.llm.packing import op8_packing
from pagemill.llm.pii import op5_pii
from pagemill.llm.quality_rules import op6_quality_rules
from pagemill.llm.resampling import op11_resampling
from pagemill.llm.token_counts import op1_token_counts
from pagemill.llm.toxicity import op4_toxicity
from pagemill.llm.whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_ngram_jaccard, op3_decontamination, op4_toxicity, op5_pii, op6_quality_rules,
        op7_language_id, op8_packing, op9_html_extraction, op10_chat_format, op11_resampling, op12_fingerprints, op13_whitening,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules.SQL, "op11_resampling": resampling.SQL}
