"""Operators that a training-data pipeline needs, and their queries."""
