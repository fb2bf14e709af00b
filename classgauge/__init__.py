"""Text classifiers trained, scored and compared as Spark table jobs."""
