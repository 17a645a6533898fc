"""Disk-fleet telemetry analytics as plain Spark DataFrame and SQL functions."""
