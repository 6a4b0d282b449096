"""PySpark-native analytics for object tracks, and for large text corpora (subpackage ``llm``)."""
