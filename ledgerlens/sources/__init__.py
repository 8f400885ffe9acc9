"""Sources of the call-audit engine."""
