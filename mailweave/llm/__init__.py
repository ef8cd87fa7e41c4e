"""Operators of a training-data pipeline over very large document tables.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` holds the registered
queries (and their DuckDB SQL, where SQL can express the operator).
"""
