"""Plans of the call-audit engine."""
