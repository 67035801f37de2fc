"""Spark-first analytics: plain DataFrame plans in, plain DataFrames out."""
