"""Document knowledge on Spark."""
