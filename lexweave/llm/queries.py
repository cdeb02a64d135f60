"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op12_bpe_encoding
from .centroids import OP13_SQL, op13_centroid_clustering
from .chat import CHAT_LAYOUTS_SQL, OP5_SQL, chat_layouts, op5_chat_formatting
from .embeddings import op7_embedding_near_dedup
from .lm import op3_lm_scoring
from .media import op8_media_columns
from .mixing import op4_mixing
from .packing import op1_best_fit_packing
from .simhash import op2_simhash_near_dedup
from .spelling import op11_spelling_variants
from .tokens import op10_token_counts
from .toxicity import op9_toxicity
from .warc import OP6_SQL, op6_warc

_ALL = (
    op1_best_fit_packing,
    op2_simhash_near_dedup,
    op3_lm_scoring,
    op4_mixing,
    op5_chat_formatting,
    op6_warc,
    op7_embedding_near_dedup,
    op8_media_columns,
    op9_toxicity,
    op10_token_counts,
    op11_spelling_variants,
    op12_bpe_encoding,
    op13_centroid_clustering,
    chat_layouts,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {"op5_chat_formatting": OP5_SQL, "op6_warc": OP6_SQL, "chat_layouts": CHAT_LAYOUTS_SQL, "op13_centroid_clustering": OP13_SQL}
