"""Whole runs and reports put together from the operators."""
