"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tidemark.llm.jaccard_join import OP7_SQL, op7_ngram_jaccard
from tidemark.llm.language_id import op5_language_id
from tidemark.llm.media_columns import op9_media_columns
from tidemark.llm.minhash_join import OP12_SQL, op12_minhash_near_dedup
from tidemark.llm.packing import op2_packing
from tidemark.llm.pieces import op4_piece_encoding
from tidemark.llm.pii import op8_pii
from tidemark.llm.quality import op10_quality
from tidemark.llm.substring_dedup import op1_substring_dedup
from tidemark.llm.token_counts import op6_token_counts
from tidemark.llm.topk_search import OP3_SQL, op3_topk_search
from tidemark.llm.whitening import op11_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_topk_search": op3_topk_search,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_pii": op8_pii,
    "op9_media_columns": op9_media_columns,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op3_topk_search": OP3_SQL, "op7_ngram_jaccard": OP7_SQL, "op12_minhash_near_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
