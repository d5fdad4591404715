"""Event, log and product analytics as plain PySpark DataFrame functions."""
