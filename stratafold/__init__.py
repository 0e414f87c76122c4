"""Cross-fitted tabular analytics as PySpark DataFrame operators."""
