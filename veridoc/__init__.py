"""Document preparation, retrieval, audit and evaluation as plain Spark jobs."""
