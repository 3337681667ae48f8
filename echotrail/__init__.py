"""Spark jobs for searching and governing timestamped text events and their vectors."""
