"""Operators of the redaction engine."""
