"""A Spark-first engine for relational, key-value, log, vector and text queries."""
