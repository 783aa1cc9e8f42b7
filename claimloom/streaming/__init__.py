"""Traces as streams."""
