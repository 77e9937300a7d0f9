"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fieldloom.llm import exact_dedup, media, mixing, near_dedup, packing, quality, secret_scan, surrogates, token_files, toxicity, warc, whitening

_MODULES = (near_dedup, toxicity, exact_dedup, media, mixing, warc, surrogates, quality, packing, token_files, whitening, secret_scan)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
