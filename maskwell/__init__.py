"""Similarity matching, index maintenance and change-log analytics on Spark."""
