"""Condition analytics on Spark: recordings, features, labels, folds, monitors and their checks."""
