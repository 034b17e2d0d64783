import inspect

import pytest

from vireo import oracles, queries
from vireo.plans import factorial

@pytest.mark.parametrize("name", oracles.ORACLES)
def test_against_sql(name, same):
    same(queries.QUERIES[name], oracles.ORACLES[name])


def test_every_checked_query_has_sql():
    assert not {f.__name__ for f in queries.CHECKED} - oracles.ORACLES.keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


@pytest.mark.parametrize("name, kernel", [("factorial_results", "execute"), ("factorial_contrasts", "execute"), ("vi_kernel_labels", "partitions")])
def test_kernels_run_with_production_settings(spark, sf, monkeypatch, name, kernel):
    real, used = getattr(factorial, kernel), {}

    def spy(*args, **more):
        bound = inspect.signature(real).bind(*args, **more)
        bound.apply_defaults()
        used.update(bound.arguments)
        return real(*args, **more)

    monkeypatch.setattr(factorial, kernel, spy)
    queries.QUERIES[name](spark, sf)
    assert (used["k"], used["particles"], used["window"]) == (8, 64, 24)


def test_calibration_tries_every_candidate(spark, sf):
    assert {r.k for r in queries.calibration_diagnostics(spark, sf).collect()} == {8, 12, 16, 24, 32}
