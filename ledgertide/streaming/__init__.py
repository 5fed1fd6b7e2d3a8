"""Structured Streaming forms of the monitors and of the rule checks."""
