"""Market-regime analytics and corpus preparation as Spark jobs."""
