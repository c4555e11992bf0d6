"""All registered queries."""

from __future__ import annotations

import functools

from molscreen.plans import queries_molecules, queries_prep, queries_rank, queries_reports, queries_screen, queries_sources, queries_store, queries_streams
from molscreen.session import ship


def _shipped(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(ship(spark), sf_dir)

    return run


QUERIES, SQL = {}, {}
for _module in (queries_rank, queries_prep, queries_store, queries_molecules, queries_screen, queries_sources, queries_streams, queries_reports):
    QUERIES.update({name: _shipped(fn) for name, fn in _module.QUERIES.items()})
    SQL.update(_module.SQL)
