"""All queries of the core, gathered."""

from __future__ import annotations

from gleanframe.plans.pipeline import PIPELINE
from gleanframe.plans.registry import Query
from gleanframe.plans.review import REVIEW
from gleanframe.plans.scoring import SCORING
from gleanframe.plans.selection import SELECTION
from gleanframe.plans.sessions import SESSIONS

REGISTRIES = [SESSIONS, SCORING, SELECTION, REVIEW, PIPELINE]


def queries() -> dict[str, Query]:
    return {k: f for r in REGISTRIES for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in REGISTRIES for k, s in r.sql.items()}
