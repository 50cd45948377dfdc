"""Readers, sinks and derived views."""
