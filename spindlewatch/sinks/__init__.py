"""Writers for telemetry tables, report results, key/value exports and timing logs."""
