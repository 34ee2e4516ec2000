"""Operators of a training-data pipeline. Nothing else in the library imports this."""
