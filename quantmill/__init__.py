"""A Spark-native engine for quantitative-finance research."""
