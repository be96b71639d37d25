"""A PySpark engine that turns web pages into clean, queryable Markdown archives."""
