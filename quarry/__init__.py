"""Document and event analytics as Spark DataFrame transforms."""
