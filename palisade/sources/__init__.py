"""Readers and derived views."""
