"""attest: review of text, pairs, keywords and logs as Spark DataFrame operations."""
