"""Mining-share ingest and analytics as Spark jobs."""
