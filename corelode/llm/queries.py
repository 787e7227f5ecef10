"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .centroids import OP12_SQL, op12_centroids
from .chat_format import OP4_SQL, op4_chat_format
from .embedding_dedup import op5_embedding_dedup
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .licenses import op7_license_scan
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import op8_mixing
from .near_dedup import op3_near_dedup
from .quality import op9_quality
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op13_suffix_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_near_dedup": op3_near_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_centroids": op12_centroids,
    "op13_suffix_dedup": op13_suffix_dedup,
}
SQL: dict[str, str] = {
    "op4_chat_format": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_centroids": OP12_SQL,
}
