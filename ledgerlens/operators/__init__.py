"""Operators of the call-audit engine."""
