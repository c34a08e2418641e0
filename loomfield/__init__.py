"""loomfield: a PySpark-native engine for corpus curation and analytics."""
