"""Extractors: source files to entities, relationships and errors."""
