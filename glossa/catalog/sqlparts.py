"""Reusable DuckDB CTE fragments for the oracles."""

from __future__ import annotations

SEED = 42


def hash_sql(key: str = "doc_id", seed: int = SEED) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def coded_cte(source_sql: str, name: str = "coded") -> str:
    """``{name}(doc_id, label, code, n_classes)`` from a (doc_id, label) query."""
    return f"""src_{name} AS ({source_sql}),
cls_{name} AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code,
                CAST(count(*) OVER () AS INTEGER) AS n_classes
         FROM (SELECT DISTINCT label FROM src_{name} WHERE label IS NOT NULL)),
{name} AS (SELECT s.*, c.code, c.n_classes FROM src_{name} s LEFT JOIN cls_{name} c
           ON s.label IS NOT DISTINCT FROM c.label)"""


def stratified_cte(coded: str = "coded", name: str = "strat", train: float = 0.8,
                   validation: float = 0.1, test: float = 0.1) -> str:
    vfrac = validation / (validation + test)
    return f"""r_{name} AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {hash_sql()}, doc_id) AS _rn,
                 count(*) OVER (PARTITION BY code) AS _n FROM {coded}),
t_{name} AS (SELECT *, round_even(CAST({train!r} AS DOUBLE) * _n, 0) AS _nt FROM r_{name}),
{name} AS (SELECT * EXCLUDE (_rn, _n, _nt),
           CASE WHEN _rn <= _nt THEN 'train'
                WHEN _rn <= _nt + round_even(CAST({vfrac!r} AS DOUBLE) * (_n - _nt), 0) THEN 'validation'
                ELSE 'test' END AS split
           FROM t_{name})"""


def random_split_cte(source: str, name: str = "rsplit", train: float = 0.8) -> str:
    return f"""r_{name} AS (SELECT *, row_number() OVER (ORDER BY {hash_sql()}, doc_id) AS _rn,
                 count(*) OVER () AS _n FROM {source}),
t_{name} AS (SELECT *, round_even(CAST({train!r} AS DOUBLE) * _n, 0) AS _nt FROM r_{name}),
{name} AS (SELECT * EXCLUDE (_rn, _n, _nt),
           CASE WHEN _rn <= _nt THEN 'train'
                WHEN _rn <= _nt + round_even(0.5 * (_n - _nt), 0) THEN 'test'
                ELSE 'validation' END AS split
           FROM t_{name})"""
