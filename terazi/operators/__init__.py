"""Operators of terazi."""
