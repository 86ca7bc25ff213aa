"""Procedural reasoning problems: specification, generation and independent verification as DataFrame expressions."""
