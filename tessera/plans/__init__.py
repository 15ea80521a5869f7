"""Named query plans: each module registers Spark builders and oracle SQL.

Import order is registration order (records, vectors, metrics, reports,
learning)."""

from tessera.plans import prep_queries  # noqa: F401  (importing registers the queries)
from tessera.plans import file_queries  # noqa: F401
from tessera.plans import vector_queries  # noqa: F401
from tessera.plans import metric_queries  # noqa: F401
from tessera.plans import report_queries  # noqa: F401
from tessera.plans import learn_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
