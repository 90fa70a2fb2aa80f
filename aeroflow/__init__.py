"""aeroflow: news and event data processing as Spark DataFrame jobs."""
