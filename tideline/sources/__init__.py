"""Readers, sinks, the model registry and report tables."""
