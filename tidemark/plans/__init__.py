"""Every registered query, grouped by subject."""
from tidemark.plans import full, learning, market, reading, signals, site, streams, study  # noqa: F401
from tidemark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
