"""Readers, and the telemetry views over the shared test tables."""
