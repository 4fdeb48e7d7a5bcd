"""Readers for raw logs and writers for results."""
