"""Operators that prepare large text collections for training; nothing else in the library imports them."""
