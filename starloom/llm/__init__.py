"""Operators that prepare records as training data; nothing else in the library imports them."""
