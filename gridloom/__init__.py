"""Table-structure analytics on Spark."""
