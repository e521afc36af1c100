"""The micro-batch engine."""
