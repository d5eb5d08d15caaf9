"""Plan invariants of every registered query: no nested-loop join, no
cartesian product, no Python UDF in the physical plan."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_no_pairwise_joins_or_python(spark):
    from plan_report import shape
    from recordfold.plans.registry import all_queries
    bad = {}
    for name, q in all_queries().items():
        s = shape(q(spark, SF))
        hits = {k: s[k] for k in ("bnlj", "cartesian", "python_udf", "pandas_udf") if s[k]}
        if hits:
            bad[name] = hits
    assert bad == {}
