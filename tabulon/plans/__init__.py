"""Query plans: the document, its checks, and its compilation to Column expressions."""
