"""The corpus queries and their SQL, gathered from the operator modules."""

from . import centroids, decontaminate, host_rules, html_text, licenses, mixing, ngram_join, resample, suffix_dedup, token_files, topk, toxicity, unit_dedup

_MODULES = (decontaminate, ngram_join, mixing, suffix_dedup, html_text, topk, licenses, toxicity, token_files, unit_dedup, centroids, host_rules, resample)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
