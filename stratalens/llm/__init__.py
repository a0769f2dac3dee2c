"""Operators of a training-data pipeline at scale; nothing else in the library imports this subpackage."""
