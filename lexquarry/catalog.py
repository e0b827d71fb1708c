"""Registered queries of the library, by name, with their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from lexquarry.queries import records, search  # noqa: F401  they register themselves
from lexquarry.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
