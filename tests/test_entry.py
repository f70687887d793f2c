import os

import pytest

import __spark_entry__


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(0 <= r.score <= 1e6 for r in rows)
