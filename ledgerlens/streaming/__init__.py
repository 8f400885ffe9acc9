"""Streaming of the call-audit engine."""
