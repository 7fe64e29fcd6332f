"""Behaviour analytics on Spark: frame tables, intervals, detectors, metrics."""
