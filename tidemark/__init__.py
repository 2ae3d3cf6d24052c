"""Tidemark: news and market-tick analytics written for Spark."""
