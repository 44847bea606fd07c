"""All registered queries."""

from sitegrain.plans import q_audit, q_extract, q_site, q_text  # noqa: F401
from sitegrain.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
