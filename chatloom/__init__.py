"""Chat-log analytics as PySpark DataFrame functions."""
