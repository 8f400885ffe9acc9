"""Functions of the call-audit engine."""
