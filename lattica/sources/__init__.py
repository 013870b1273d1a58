"""Readers of vendor files and builders of panels."""
