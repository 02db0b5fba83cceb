"""Comprehension of legacy programs and screens, and the versioned knowledge they yield."""
