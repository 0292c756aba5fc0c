"""All registered queries."""

from dialogue_lake.plans import (  # noqa: F401
    catalog_audit,
    catalog_claims,
    catalog_reports,
    catalog_speech,
    catalog_terms,
)
from dialogue_lake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
