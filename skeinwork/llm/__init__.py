"""Operators for training-data pipelines: filtering, deduplication, decontamination and mixing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames, ignores extra
columns of its input and names its result columns itself, so clashing extra columns do no harm.
"""
