"""Frame-dataflow analytics on Apache Spark."""
