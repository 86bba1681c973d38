"""Operators that keep state on streams."""
