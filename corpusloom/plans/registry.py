"""Name to query; results are complete tables with stable column names."""

from __future__ import annotations

import functools

from corpusloom.session import apply_runtime_conf

QUERIES: dict = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(apply_runtime_conf(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn
