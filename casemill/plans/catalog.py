"""All registered queries."""

from casemill.plans import (  # noqa: F401
    comparison,
    detector,
    experiments,
    files,
    models,
    streams,
    texts,
)
from casemill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
