"""Operators put together to whole jobs."""
