"""Operators that prepare training text: one module for each, and their queries."""
