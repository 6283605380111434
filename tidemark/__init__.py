"""tidemark: event analytics on Spark.

Parse event messages, keep a versioned dimension table, enrich events, aggregate them in
sliding event-time windows under a watermark, correct closed windows for late data, store the
results and query them. Every operator is a ``DataFrame -> DataFrame`` function.
"""

from tidemark.session import prepare, session

__all__ = ["prepare", "session"]
