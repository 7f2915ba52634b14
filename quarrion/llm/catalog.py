"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from .html_text import op7_html_text
from .importance import op6_importance
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .mixing import op10_mixing
from .order_minhash import op2_order_minhash
from .pii import op1_pii
from .quality_rules import OP4_SQL, op4_quality_rules
from .sentencepiece_codec import op8_sentencepiece
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .toxicity import op5_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_order_minhash": op2_order_minhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_importance": op6_importance,
    "op7_html_text": op7_html_text,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL = {
    "op3_substring_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op9_jaccard_join": OP9_SQL,
}
