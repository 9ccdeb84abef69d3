"""Transaction-risk analytics on PySpark: DataFrame-in, DataFrame-out operators."""
