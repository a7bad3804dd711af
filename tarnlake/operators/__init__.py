"""Relational operators of the dialect as DataFrame functions."""
