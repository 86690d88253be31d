"""All queries of this subpackage."""

from scorefold.llm import (  # noqa: F401
    bpe, divergence, embedding_dedup, exact_dedup, html_text, katz_lm, language_id, minhash_dedup, packing, quality, ranked_search,
    secret_scan, toxicity,
)
from scorefold.llm.registry import QUERIES

__all__ = ["QUERIES"]
