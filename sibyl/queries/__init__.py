"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from .base import Query
from .graphs import QUERIES as _GRAPHS
from .hitlists import QUERIES as _HITLISTS
from .plans import QUERIES as _PLANS
from .retrieval import QUERIES as _RETRIEVAL
from .sequences import QUERIES as _SEQUENCES

QUERIES: dict[str, Query] = {**_RETRIEVAL, **_GRAPHS, **_HITLISTS, **_PLANS, **_SEQUENCES}
