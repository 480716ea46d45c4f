"""Operators for training data. Nothing else in the library imports this package."""


def queries() -> dict:
    from . import catalogue as q

    return q.queries()


def oracle_sql() -> dict:
    from . import catalogue as q

    return q.oracle_sql()
