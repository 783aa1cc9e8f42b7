"""Operators on the relations of evidence graphs."""
