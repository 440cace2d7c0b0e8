"""Streaming of the redaction engine."""
