"""Registered queries: each area gives its Spark query and, where SQL can say it, the same in SQL."""
