"""Readers of captured data and writers of exports."""
