"""Command-telemetry analytics on Spark."""
