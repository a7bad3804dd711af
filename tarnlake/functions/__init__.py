"""Aggregate functions of the dialect."""
