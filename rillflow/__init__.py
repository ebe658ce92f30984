"""Ordered record streams, shard stores, catalogs and mixing on Spark DataFrames."""
