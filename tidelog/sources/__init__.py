"""Where logs are kept: Parquet segments under a manifest."""
