"""Rule-driven web-content extraction and library analytics as Spark jobs."""
