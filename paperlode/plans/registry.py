"""The queries of the operator inventory and their DuckDB twins, by operator id."""

from __future__ import annotations

from .views import oracle

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def op(key: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with the SQL that DuckDB must agree with."""

    def add(f):
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = oracle(sql)
        return f

    return add


from . import group_a, group_b, group_c, group_d, group_e, group_f, group_g, group_h, group_i, group_j, group_k, group_l, group_m  # noqa: E402, F401
