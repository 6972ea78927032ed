"""All registered queries; importing the modules registers them."""

from monthmark.plans.catalog import (aggregate_queries, change_queries,  # noqa: F401
                                       portfolio_queries, io_queries, stream_queries)
from monthmark.plans.registry import ORACLES, QUERIES  # noqa: F401
