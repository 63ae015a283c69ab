"""Coverage analytics for large many-to-many reference tables, as Spark jobs."""
