"""hushframe: page-privacy and agent-telemetry analytics as Spark DataFrame operators."""
