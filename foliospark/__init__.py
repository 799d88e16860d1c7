"""foliospark: document and image processing pipelines as Spark DataFrame programs."""
