"""Readers: files, parsed documents, and the plug-in boundaries."""
