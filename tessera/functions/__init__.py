"""Scalar semantics as Spark columns."""
