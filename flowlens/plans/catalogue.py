"""All registered queries."""

from flowlens.plans import monitoring, pages, parsing, stored, streams  # noqa: F401
from flowlens.plans.registry import ORACLES, QUERIES  # noqa: F401
