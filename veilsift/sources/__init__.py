"""Readers that turn captures and files into posting rows."""
