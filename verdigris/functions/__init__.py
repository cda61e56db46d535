"""Disclosure analytics on Spark: functions."""
