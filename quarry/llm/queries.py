"""The queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from . import importance_resampling
from .ann import op7_inverted_multi_index
from .chat_format import op6_chat_format
from .decontamination import op3_benchmark_decontamination
from .html_extract import op5_html_extraction
from .language_id import op11_language_id
from .language_model import op9_lm_scoring
from .packing import op1_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .sharding import op2_rendezvous_sharding
from .simhash_dedup import op4_simhash_dedup
from .toxicity import op8_toxicity
from .warc import op10_warc_derivatives

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_rendezvous_sharding": op2_rendezvous_sharding,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_chat_format": op6_chat_format,
    "op7_inverted_multi_index": op7_inverted_multi_index,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_language_id": op11_language_id,
    "op12_importance_resampling": importance_resampling.op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

#: The others can't be expressed in SQL (hashes, tokenizers, models, fixed points); tests/llm compares them with plain versions.
ORACLE: dict[str, str] = {"op12_importance_resampling": importance_resampling.ORACLE}
