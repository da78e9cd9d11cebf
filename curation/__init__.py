"""A PySpark-native engine that curates catalogue records from pages and files."""
