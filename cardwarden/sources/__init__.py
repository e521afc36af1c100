"""Readers for transaction lines and the dictionary, and the engine's tables."""
