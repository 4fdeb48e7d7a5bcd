"""All queries of this subpackage and their SQL twins."""

from roadlens.llm import (  # noqa: F401
    bitplane_kmeans,
    bpe_codec,
    html_text,
    jaccard_join,
    language_cnn,
    lexical_search,
    line_templates,
    matroska,
    mixing,
    quality_cotraining,
    suffix_dedup,
    token_counts,
    vector_graph,
)
from roadlens.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
