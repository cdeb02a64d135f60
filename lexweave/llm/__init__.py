"""Operators for building training data; nothing outside this subpackage imports them."""
