"""sweepline: spatial time-series analytics as Spark DataFrame operators."""
