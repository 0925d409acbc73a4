"""Workbooks: reading, writing and filling OOXML files."""
