"""All registered queries."""

from __future__ import annotations

from vouchsafe.plans import (  # noqa: F401
    browse_queries, evaluation_queries, guardrail_queries, layout_queries, model_queries, review_queries, stream_queries, validation_queries,
)
from vouchsafe.plans.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
