"""The registered queries, grouped by what they exercise."""

from rowsmith.plans.registry import Tables, registered

__all__ = ["Tables", "registered"]
