"""heronry: Spark-first analytics for event registers and text corpora."""
