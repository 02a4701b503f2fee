"""Readers of messages and tables."""
