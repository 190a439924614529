"""All registered queries; importing the modules registers them."""

from vigilflow.plans import (  # noqa: F401
    analytics_queries,
    case_queries,
    flow_queries,
    hunting_queries,
    model_queries,
    report_queries,
    stream_queries,
    upkeep_queries,
)
from vigilflow.plans.registry import ORACLES, QUERIES  # noqa: F401
