"""Plans of the redaction engine."""
