"""Lazy signal expressions and their compilation."""
