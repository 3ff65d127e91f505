"""Imports every module of the operators, which registers their queries."""

from __future__ import annotations

from labelq.llm import (  # noqa: F401
    decontaminate,
    hamming_search,
    jaccard_join,
    language_id,
    learned_partitions,
    mixing,
    periodic_runs,
    personal_data,
    repeats,
    source_divergence,
    token_counts,
    token_store,
    unit_dedup,
)
from labelq.llm.base import ORACLES, QUERIES


def load():
    return QUERIES, ORACLES
