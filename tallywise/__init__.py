"""Customer value analytics as Spark DataFrame operators."""
