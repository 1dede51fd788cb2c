"""Search, evaluation, telemetry and ingestion over a document corpus, on Spark."""
