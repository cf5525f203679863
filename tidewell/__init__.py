"""tidewell: notice, document and release analytics as Spark jobs."""
