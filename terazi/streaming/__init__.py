"""Streaming of terazi."""
