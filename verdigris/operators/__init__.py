"""Disclosure analytics on Spark: operators."""
