"""Scalar functions as Columns: identifiers, timestamps, content ids, backoff and binary codecs."""
