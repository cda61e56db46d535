"""Disclosure analytics on Spark: sources."""
