"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, conversation, decontamination, html_text, jaccard, jpeg, language, mixing, packing, pii, quality, topk, toxicity

_MODULES = (mixing, packing, html_text, topk, language, jaccard, toxicity, quality, jpeg, pii, conversation, alignment, decontamination)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
