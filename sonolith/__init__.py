"""Signal-comparison analytics as Spark jobs."""
