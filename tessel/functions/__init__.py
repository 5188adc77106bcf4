"""Scalar functions: column expressions and driver-side parsers."""
