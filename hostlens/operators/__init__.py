"""Analytical operators over events, sessions and metrics."""
