"""Move tables and keep them in step, as Spark jobs."""
