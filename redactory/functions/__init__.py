"""Functions of the redaction engine."""
