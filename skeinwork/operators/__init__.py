"""Operators on repositories, streams and records as DataFrame transformations."""
