"""Relational and domain operators."""
