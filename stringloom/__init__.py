"""String extraction and text processing as Spark jobs."""
