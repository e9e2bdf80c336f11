"""What Spark makes of a query."""
