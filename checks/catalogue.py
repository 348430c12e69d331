"""All queries."""

from checks import columns, ranking, sources, tables, training  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
