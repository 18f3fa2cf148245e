"""Spark-native analytics over streams and archives of signed, content-addressed record mutations."""
