from tagloom.queries import datasets, files, labels, models, ordering, sampling, vectors  # noqa: F401
from tagloom.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
