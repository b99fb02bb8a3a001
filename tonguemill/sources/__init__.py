"""Folders, containers and sinks."""
