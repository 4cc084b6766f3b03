"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pairlake.llm import (  # noqa: F401
    queries_chat,
    queries_rows,
    queries_texts,
    queries_tokens,
    queries_vectors,
)
from pairlake.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
