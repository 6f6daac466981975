"""Rehabilitation-protocol analytics as Spark DataFrame transformations."""
