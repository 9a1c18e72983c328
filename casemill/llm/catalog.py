"""All registered queries of the subpackage."""

from casemill.llm import queries  # noqa: F401
from casemill.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
