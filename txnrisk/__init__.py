"""Card-transaction risk analytics as Spark DataFrame jobs."""
