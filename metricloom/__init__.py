"""Log-to-metrics analytics on Apache Spark."""
