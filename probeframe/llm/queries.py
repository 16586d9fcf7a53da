"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import line_dedup, ngram_join, passages, spot_signatures, warc
from .hashing_search import op2_multi_index_hashing
from .line_dedup import op4_line_dedup
from .mixing import op10_mix_sources
from .ngram_join import op9_ngram_jaccard_join
from .packing import op6_nnls_packing
from .passages import op7_repeated_phrases
from .spot_signatures import op3_spot_signatures
from .token_matrix import op8_token_matrices
from .toxicity import op5_toxicity

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_multi_index_hashing": op2_multi_index_hashing,
    "op3_spot_signatures": op3_spot_signatures,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_nnls_packing": op6_nnls_packing,
    "op7_repeated_phrases": op7_repeated_phrases,
    "op8_token_matrices": op8_token_matrices,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_mix_sources": op10_mix_sources,
}

ORACLES = {
    "op1_warc": warc.ORACLE, "op3_spot_signatures": spot_signatures.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op7_repeated_phrases": passages.ORACLE, "op9_ngram_jaccard_join": ngram_join.ORACLE,
}
