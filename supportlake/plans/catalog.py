"""All registered queries; importing a plan module registers its queries."""

from supportlake.plans.registry import ORACLES, QUERIES  # noqa: F401
from supportlake.plans import (  # noqa: F401
    text_queries,
    conversation_queries,
    merge_queries,
    retrieval_queries,
    guard_queries,
    evaluation_queries,
    io_queries,
)
