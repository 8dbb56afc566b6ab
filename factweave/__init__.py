"""factweave: evidence tables and training-data preparation as Spark DataFrame jobs."""
