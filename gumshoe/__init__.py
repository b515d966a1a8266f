"""Investigation-graph analytics as Spark DataFrame operators."""

from gumshoe.quest import Quest

__all__ = ["Quest"]
