"""Readers, generated dimensions and writers."""
