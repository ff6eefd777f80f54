"""Form-data standardization as Spark DataFrame jobs."""
