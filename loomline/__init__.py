"""loomline: a PySpark-native engine for long-form text as ordered relational data."""
