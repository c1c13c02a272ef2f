"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_formatting
from .langid import op8_language_id
from .minhash import op7_fingerprints
from .mixing import OP6_SQL, op6_mixing
from .packing import op10_packing
from .quality import OP9_SQL, op9_quality_rules
from .simhash import op4_simhash
from .tokens import op2_token_counts
from .toxicity import op1_toxicity
from .urls import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_simhash": op4_simhash,
    "op5_url_filters": op5_url_filters,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
}
ORACLES = {"op3_chat_formatting": OP3_SQL, "op5_url_filters": OP5_SQL, "op6_mixing": OP6_SQL, "op9_quality_rules": OP9_SQL}
