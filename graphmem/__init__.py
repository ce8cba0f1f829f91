"""A PySpark engine for bi-temporal knowledge-graph memory."""
