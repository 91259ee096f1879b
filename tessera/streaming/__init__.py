"""Streams of records: files that arrive are checked and counted as they come."""
