"""Time-indexed evidence over many series, as Spark DataFrame operators."""
