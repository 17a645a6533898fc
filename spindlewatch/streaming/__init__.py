"""Incremental arrival of raw telemetry."""
