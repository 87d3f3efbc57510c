"""Operators of a training-data pipeline, their queries and the SQL they are checked with."""
