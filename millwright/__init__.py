"""Machine-telemetry analytics as Spark DataFrame jobs."""
