"""Query plans: the checked queries (one per operator) and composite runs."""

from .registry import ORACLES, QUERIES, query, rounded  # noqa: F401
from . import q_flows, q_sampling, q_graph, q_models, q_misc  # noqa: F401,E402
