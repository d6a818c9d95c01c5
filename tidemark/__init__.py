"""Search-performance and content analytics on Spark."""
