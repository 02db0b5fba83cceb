"""Operators on text and names for corpus building. Nothing else in the library imports this package."""
