"""A PySpark-native engine for multilingual retrieval corpora."""
