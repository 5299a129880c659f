"""All named queries. Importing a module registers its entries."""

from . import acquisition, columns, stored, stories, web  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
