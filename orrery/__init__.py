"""Frame-indexed and event-driven analytics on Spark."""
