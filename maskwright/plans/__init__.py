"""Registered queries."""

from . import more
from .queries import QUERIES

__all__ = ["QUERIES", "more"]
