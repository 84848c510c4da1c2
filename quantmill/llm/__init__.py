"""Operators of a training-data pipeline over text, vectors, pages and chats.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
