"""Clinical-trial analytics as Spark DataFrame jobs."""
