"""Blockloom: declarative, incremental DataFrame pipelines on Spark."""
