"""All registered queries of this folder."""

from filespoor.llm import (  # noqa: F401
    bpe, exact_dedup, hnsw, language, line_dedup, packing, prefix_trie, quality, runs, simhash, token_count, toxicity, url_filter,
)
from filespoor.llm.registry import CHECKS, QUERIES  # noqa: F401
