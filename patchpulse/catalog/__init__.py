"""Named queries over the supplied tables."""

from . import impact_queries, model_queries, review_queries, risk_queries, source_queries, stream_queries, trend_queries  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
