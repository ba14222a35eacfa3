"""Whole plans put together from operators, and the adapter views that the queries run on."""
