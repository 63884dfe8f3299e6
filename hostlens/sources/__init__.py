"""Readers and parsers that produce audit events."""
