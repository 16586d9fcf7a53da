"""Structured Streaming versions of the step machine and the delivery rules."""
