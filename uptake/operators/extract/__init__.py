"""Fact extraction from source texts, one module per language.

An extractor is a function from a ``source_files`` table to fact tables.  Each
file is worked on inside its own row; joins only start when symbols are
resolved across files.  The texts are read with patterns over masked source, not
with grammars; the README lists what that cannot see.
"""
