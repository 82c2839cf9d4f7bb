"""textloom: a PySpark-native indexer and text/code processing library."""
