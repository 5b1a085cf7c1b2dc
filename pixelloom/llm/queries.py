"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from .byte_bpe import op1_byte_bpe
from .centroids import OP13_SQL, op13_centroid_clustering
from .embedding_dedup import op5_embedding_dedup
from .html_extract import op8_html_extraction
from .jaccard_join import op9_jaccard_join
from .language_id import op10_language_id
from .lexical_search import OP12_SQL, op12_lexical_search
from .line_dedup import OP7_SQL, op7_line_dedup
from .match_model import op11_match_model
from .packing import op2_packing
from .quality_model import op6_quality_model
from .quality_rules import OP3_SQL, op3_quality_rules
from .url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_model": op6_quality_model,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_match_model": op11_match_model,
    "op12_lexical_search": op12_lexical_search,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLE_SQL = {"op3_quality_rules": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_line_dedup": OP7_SQL, "op12_lexical_search": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
