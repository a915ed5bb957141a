"""Registered queries and their SQL counterparts."""


def queries() -> dict:
    from . import composed  # noqa: F401 - registers its queries
    from .catalog import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict:
    from . import composed  # noqa: F401
    from .catalog import SQL

    return dict(SQL)
