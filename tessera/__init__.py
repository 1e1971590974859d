"""Self-accelerating analytics on Spark."""
