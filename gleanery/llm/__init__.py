"""Operators for building training corpora (optional subpackage)."""
