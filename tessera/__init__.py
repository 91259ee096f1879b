"""Typed-record analytics on Spark: relational operators, conversion plans and services over DataFrames."""
