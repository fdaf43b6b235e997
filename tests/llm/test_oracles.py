import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

from quarry.llm.queries import oracle_sql, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    compare(spark, connect(), queries()[name], oracle_sql()[name])
