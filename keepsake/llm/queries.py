"""The queries of this package, their SQL and the pipeline, as __spark_entry__ registers them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, licences, ngram_join, packing, pii, quality, token_files, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_licences": licences.op5_licences,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLES = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_url_filter": url_filter.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op10_ngram_join": ngram_join.SQL,
}
