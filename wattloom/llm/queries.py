"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from wattloom.llm import centroids, language_id, licenses, media, mixing, neighbours, ngram_join, personal_data, pieces, quality, repeats, token_files, vector_codes

MODULES = (ngram_join, mixing, quality, licenses, token_files, neighbours, personal_data, pieces, media, language_id, repeats, vector_codes, centroids)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
