"""Feature preparation, profiling and selection as Spark DataFrame operators."""
