"""Readers of the relations and sinks."""
