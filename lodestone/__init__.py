"""Lodestone: a relational query engine on PySpark."""

from .session import Engine, Result

__all__ = ["Engine", "Result"]
