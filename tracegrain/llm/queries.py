"""The queries of the corpus operators, by name, and ORACLE, DuckDB SQL where SQL can express one."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .graph_dedup import op5_vector_graph
from .language_id import op6_language_id
from .license_scan import op2_license_scan
from .minhash_dedup import op1_minhash
from .mixing import op4_mixing
from .oracles import ORACLE
from .quality import op3_quality
from .suffix_dedup import op10_suffix_dedup
from .token_counts import op8_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_vector_graph": op5_vector_graph,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
}

__all__ = ["ORACLE", "QUERIES"]
