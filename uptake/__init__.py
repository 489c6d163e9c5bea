"""Design-system adoption analytics as Spark DataFrame operators."""
