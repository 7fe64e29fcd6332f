"""Scalar expressions and constants."""
