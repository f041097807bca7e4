"""Social-signal analytics as Spark DataFrame jobs."""
