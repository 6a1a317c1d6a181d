"""strandframe: schema-described line records as DataFrames, with Spark-first operators."""
