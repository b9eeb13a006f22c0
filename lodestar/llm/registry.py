"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, html_text, langid, merkle, packing, quality, repeats, simhash, suffix_tree_lm, toxicity, url_filters

MODULES = (html_text, simhash, suffix_tree_lm, repeats, toxicity, quality, exact_dedup, langid, bpe, packing, divergence, url_filters, merkle)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
