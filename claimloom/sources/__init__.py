"""Readers, writers and providers."""
