"""Evidence search over document collections as Spark jobs."""
