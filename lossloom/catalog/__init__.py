"""Registered queries over the given tables, each with the SQL it is compared to."""


def queries():
    from lossloom.catalog import (  # noqa: F401
        batch_queries,
        core_queries,
        generation_queries,
        loop_queries,
        source_queries,
        text_queries,
    )
    from lossloom.catalog.registry import QUERIES

    return dict(QUERIES)


def oracles():
    queries()
    from lossloom.catalog.registry import ORACLES

    from lossloom.catalog.sql import query

    return {name: query(sql) for name, sql in ORACLES.items()}
