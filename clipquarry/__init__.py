"""Short-form media analytics as Spark DataFrame operators."""
