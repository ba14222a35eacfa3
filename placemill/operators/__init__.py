"""Operators over place tables."""
