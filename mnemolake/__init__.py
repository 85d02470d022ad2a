"""PySpark-native analytics over conversational memory and text corpora."""
