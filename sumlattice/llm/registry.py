"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import ann, bpe, classifier, fim, hardneg, jaccard, neardup, packing, pii, quality_rules, substrings, toxicity, warc

_MODULES = (jaccard, substrings, pii, toxicity, quality_rules, ann, classifier, bpe, packing, warc, fim, neardup, hardneg)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
