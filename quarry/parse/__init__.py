"""Symbols and edges of source files, without a grammar engine: Python by its own parser, the others by their blocks."""
