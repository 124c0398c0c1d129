"""Network-flow analytics on Spark."""
