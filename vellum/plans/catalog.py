"""All registered queries and, where SQL can express them, their equivalent SQL."""

from vellum.plans import layout_queries, model_queries, page_queries, service_queries, stream_queries, table_queries, text_queries  # noqa: F401
from vellum.plans.registry import ORACLES, QUERIES  # noqa: F401
