"""Analytics over noisy sequential records, as Spark DataFrame operators."""
