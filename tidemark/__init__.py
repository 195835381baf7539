"""tidemark: hybrid retrieval, incremental ingest and corpus preparation on Spark."""
