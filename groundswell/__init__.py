"""Area growth scoring as Spark DataFrame jobs."""
