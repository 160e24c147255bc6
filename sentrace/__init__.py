"""Session behaviour analytics as Spark DataFrame operators."""
