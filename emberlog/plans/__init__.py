"""Requests as they come, turned into plans."""
