"""Spark jobs for the life of a tabular ML model as data."""
