"""Operators on log rows."""
