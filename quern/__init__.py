"""A Spark-native analytics engine: plans are declared with DataFrames and SQL, Catalyst runs them."""
