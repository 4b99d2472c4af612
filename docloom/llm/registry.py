"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .ann import op6_nearest_neighbours
from .bpe import op5_bpe_tokens
from .decontamination import OP9_SQL, op9_decontamination
from .language_id import op7_language_id
from .license_scan import op3_license_scan
from .ngram_join import OP1_SQL, op1_ngram_jaccard_join
from .pii import op4_pii
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .token_store import op8_token_store
from .toxicity import op10_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_pii": op4_pii,
    "op5_bpe_tokens": op5_bpe_tokens,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_id": op7_language_id,
    "op8_token_store": op8_token_store,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op9_decontamination": OP9_SQL,
}
