"""A PySpark engine for dictionary corpora: sources, lookup, search and rendering."""
