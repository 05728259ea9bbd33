"""Entity resolution for business listings as Spark DataFrame jobs."""
