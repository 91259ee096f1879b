"""Relational operators and services over DataFrames."""
