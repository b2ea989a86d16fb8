"""Continuous scans."""
