"""Transaction-operations analytics as Spark DataFrame operators."""
