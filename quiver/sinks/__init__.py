"""Exports and reports."""
