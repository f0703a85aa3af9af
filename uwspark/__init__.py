"""Credit-underwriting analytics on whole populations, written as Spark jobs."""
