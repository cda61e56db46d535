"""Disclosure analytics on Spark: streaming."""
