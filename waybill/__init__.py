"""Fleet telemetry analytics on Spark."""
