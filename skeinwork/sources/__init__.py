"""Readers and writers: block archives, event frames and JSON feeds."""
