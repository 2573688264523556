"""Document search and corpus processing expressed as Spark DataFrame plans."""
