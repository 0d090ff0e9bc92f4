"""The queries of this subpackage, with their SQL where it can express them."""

from __future__ import annotations

from holdfast.llm import bpe_query, decontamination_query, embeddings_query, exact_dedup_query, hard_negatives_query, jaccard_query, language_query, mixing_query, prefix_trie_query, secrets_query, toxicity_query, urls_query, warc_query

_MODULES = (language_query, secrets_query, urls_query, exact_dedup_query, mixing_query, warc_query, bpe_query, toxicity_query, jaccard_query, embeddings_query, hard_negatives_query, decontamination_query, prefix_trie_query)

QUERIES = {m.NAME: m.run for m in _MODULES}
ORACLES = {m.NAME: m.SQL for m in _MODULES if m.SQL}
