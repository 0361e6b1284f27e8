"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import engine, factor_models, flows, graphs, recommend, streams
from .graphs import flagship  # noqa: F401

QUERIES = {**graphs.QUERIES, **recommend.QUERIES, **factor_models.QUERIES, **flows.QUERIES, **streams.QUERIES, **engine.QUERIES}
SQL = {**graphs.SQL, **recommend.SQL, **factor_models.SQL, **flows.SQL, **streams.SQL, **engine.SQL}
