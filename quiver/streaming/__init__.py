"""Keeping a graph up to date from a stream of file events."""
