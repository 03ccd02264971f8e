"""Cost-sensitive failure analytics on wide feature tables, as Spark DataFrame operators."""
