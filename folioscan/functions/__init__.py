"""Document-quality analytics on Spark."""
