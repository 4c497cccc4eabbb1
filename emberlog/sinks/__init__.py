"""Sinks: stored tables, documents for an external index, results and alerts."""
