"""The ingest job."""
