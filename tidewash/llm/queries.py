"""Everything that is registered, by importing the modules that register it."""

from tidewash.llm import (  # noqa: F401
    centroids,
    decontaminate,
    exact_dedup,
    fill_middle,
    html_text,
    lattice,
    lm_scoring,
    packing,
    quality,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
)
from tidewash.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
