"""The training-data queries and their SQL."""

from __future__ import annotations

from . import codes, fingerprints, licenses, mixing, packing, quality, runs, secrets, segmentation, simhash, suffix_lm, topk, toxicity
from .common import configured

_MODULES = (codes, fingerprints, licenses, mixing, packing, quality, runs, secrets, segmentation, simhash, suffix_lm, topk, toxicity)


def queries():
    return {name: configured(q) for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
