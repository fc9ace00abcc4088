"""Every registered query of the library proper against its SQL, on the smallest tables."""

import pytest

from ballast.plans import convert, metrics, mixture, registry, report, sources, workflows  # noqa: F401
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLE:
        check(spark, name, registry.QUERIES[name], registry.ORACLE[name], SF)
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0
