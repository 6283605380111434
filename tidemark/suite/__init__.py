"""Named queries over the supplied tables, each with its SQL counterpart where SQL can say it."""

from tidemark.suite import (  # noqa: F401  (importing a module registers its queries)
    dimension,
    ingest,
    measures,
    sql_surface,
    stored,
    streams,
    watermark,
    windows,
)
from tidemark.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
