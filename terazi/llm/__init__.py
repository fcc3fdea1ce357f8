"""Operators for text and language-model data; nothing else in the library imports them."""
