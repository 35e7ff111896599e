"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from siftguard.llm.alignment import op13_cross_tokenizer_alignment
from siftguard.llm.decontamination import op6_benchmark_decontamination
from siftguard.llm.language_id import op4_language_id
from siftguard.llm.licenses import op10_license_scans
from siftguard.llm.mixing import op3_mixing_sources_to_target_weights
from siftguard.llm.near_duplicates import op2_minhash_near_dedup
from siftguard.llm.oracles import ORACLES
from siftguard.llm.periodic_runs import op11_periodic_run_detection
from siftguard.llm.personal_data import op5_pii
from siftguard.llm.secret_scan import op1_secret_scans
from siftguard.llm.substrings import op8_substring_dedup
from siftguard.llm.token_counts import op12_token_counts
from siftguard.llm.toxicity import op9_toxicity
from siftguard.llm.vector_search import op7_exact_top_k

QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_minhash_near_dedup, op3_mixing_sources_to_target_weights, op4_language_id, op5_pii, op6_benchmark_decontamination, op7_exact_top_k, op8_substring_dedup, op9_toxicity, op10_license_scans,
    op11_periodic_run_detection, op12_token_counts, op13_cross_tokenizer_alignment)}

__all__ = ["ORACLES", "QUERIES"]
