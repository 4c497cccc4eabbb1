"""Log analytics on Spark: ingest, suppression, search, rollups and retention."""
