"""The text operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op9_byte_bpe
from .chat_format import OP8_SQL, op8_chat_format
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .language import op10_language_id
from .packing import op7_packing
from .quality import OP1_SQL, op1_quality_rules
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .toxicity import op5_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat_format,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
}

SQL = {
    "op1_quality_rules": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op8_chat_format": OP8_SQL,
}
