"""Queries over the given tables, one per operator or job."""


def load():
    """(queries, SQL twins) by name."""
    from workload import catalogue_queries, geometry_queries, io_queries, job_queries, label_queries, text_queries  # noqa: F401
    from workload.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
