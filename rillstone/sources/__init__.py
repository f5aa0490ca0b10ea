"""Readers and reports."""
