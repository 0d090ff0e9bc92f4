"""Customer-retention analytics and model monitoring as Spark DataFrame jobs."""
