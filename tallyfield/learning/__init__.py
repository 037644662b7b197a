"""Feature vectors, classifiers and parameter search on Spark ML."""
