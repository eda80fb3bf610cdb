"""Imports every plan module so that the registry is complete."""

from . import models, orders, passages, routing, streams, text, vectors  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
