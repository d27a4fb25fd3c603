"""Collects the registered queries and their oracle SQL from every plan module."""

from __future__ import annotations


def _wrap(fn):
    def run(spark, sf_dir):
        from crowdlake.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict:
    from crowdlake.plans import io_queries, ml_queries, queries, stream_queries

    out = queries.QUERIES | io_queries.QUERIES | ml_queries.QUERIES | stream_queries.QUERIES
    return {k: _wrap(v) for k, v in out.items()}


def all_oracle_sql() -> dict:
    from crowdlake.plans import io_queries, ml_queries, oracle, stream_queries

    out = oracle.ORACLE | io_queries.ORACLE | ml_queries.ORACLE | stream_queries.ORACLE
    keys = set(all_queries())
    return {k: v for k, v in out.items() if k in keys}
