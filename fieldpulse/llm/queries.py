"""All registered queries of this package."""

from fieldpulse.llm import bpe, collocations, conversation_trie, decontaminate, jaccard_join, language, licenses, mixing, quality_model, quality_rules, secrets, sharding, suffix_dedup  # noqa: F401  (they register themselves)
from fieldpulse.llm.registry import QUERIES

__all__ = ["QUERIES"]
