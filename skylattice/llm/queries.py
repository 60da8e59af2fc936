"""Queries of the text operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from . import fingerprint, html_text, language, mixing, ngram_join, personal_data, ranked_search, sentence_pieces, token_counts, topk, url_filter, vector_codes, warc

_MODULES = (html_text, sentence_pieces, token_counts, ngram_join, language, url_filter, warc, mixing, fingerprint, topk, ranked_search, personal_data, vector_codes)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
