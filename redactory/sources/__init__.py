"""Sources of the redaction engine."""
