"""Keyed, last-write-wins tables on Spark: an ordered log of upserts and deletes resolved to the latest live values."""
