"""All registered queries."""

from newsloom.plans import (  # noqa: F401
    curation,
    digest_queries,
    evaluation_queries,
    ingest_queries,
    library_queries,
    scalars,
    story_queries,
    stream_queries,
)
from newsloom.plans.registry import ORACLES, QUERIES  # noqa: F401
