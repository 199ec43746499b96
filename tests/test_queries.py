"""Every query of the core against its SQL, over the whole smallest tables."""

import importlib.util
from pathlib import Path

import pytest

from cairnlake.plans import registry

_path = Path(__file__).resolve().parent.parent / "tools" / "compare.py"
_spec = importlib.util.spec_from_file_location("compare", _path)
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con(root):
    return compare.connect(root)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, root, name):
    ok, said = compare.compare(spark, con, name, root)
    assert ok, said


def test_every_sql_has_a_query():
    assert set(registry.sql()) <= set(registry.queries())
