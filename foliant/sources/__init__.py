"""Readers and writers: registries, tool-backed sources, sinks."""
