"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from strata.llm import (
    op1_url_filter,
    op2_quality,
    op3_language,
    op4_jaccard,
    op5_substrings,
    op6_warc,
    op7_license,
    op8_decontaminate,
    op9_toxicity,
    op10_packing,
    op11_hmm,
    op12_whitening,
)


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter.query,
        "op2_quality": op2_quality.query,
        "op3_language": op3_language.query,
        "op4_jaccard": op4_jaccard.query,
        "op5_substrings": op5_substrings.query,
        "op6_warc": op6_warc.query,
        "op7_license": op7_license.query,
        "op8_decontaminate": op8_decontaminate.query,
        "op9_toxicity": op9_toxicity.query,
        "op10_packing": op10_packing.query,
        "op11_hmm": op11_hmm.query,
        "op12_whitening": op12_whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": op1_url_filter.SQL,
        "op2_quality": op2_quality.SQL,
        "op4_jaccard": op4_jaccard.SQL,
        "op6_warc": op6_warc.SQL,
        "op7_license": op7_license.SQL,
    }
