"""Analytics over repeat observations (values at a place at many times) as composable Spark DataFrame operators."""
