"""Whole runs and report tables, composed from the operators."""
