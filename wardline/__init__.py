"""Hospital-operations analytics on Spark DataFrames, Spark SQL, Structured Streaming and pyspark.ml."""
