"""Operations of a training-data pipeline, each a module of its own.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
