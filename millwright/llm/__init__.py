"""Operators that prepare training text, independent of the rest of the library."""
