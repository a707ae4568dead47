"""Every query of the engine's own operators runs, and equals its oracle where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from oracle import DATA, HAVE_DATA, compare  # noqa: E402

from quillgrid.plans import registry  # noqa: E402

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.skipif(not HAVE_DATA, reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.skipif(not HAVE_DATA, reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not HAVE_DATA, reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
