"""Registered queries, their mapping views and their SQL checks."""

from qaloom.plans import documents, execution, intake, pages, reports  # noqa: F401
from qaloom.plans.registry import CHECKS, QUERIES  # noqa: F401
