"""Every query of the engine against its SQL, or for its shape where SQL can't express it."""

import pytest

from skerry.queries import ORACLE_SQL, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        check(frame, ORACLE_SQL[name], sf)
    else:
        assert frame.count() > 0
