"""Typed property graphs and training-data operators on Spark."""
