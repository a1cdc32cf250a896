"""newsgauge: coverage analytics as Spark DataFrame operators."""
