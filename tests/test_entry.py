"""The registry: no query hides another, and every twin belongs to a query."""

import __spark_entry__ as entry


def test_names_are_unique():
    modules = entry._modules()
    names = [name for module in modules for name in module.QUERIES]
    assert len(names) == len(set(names)) == len(entry.queries())
    assert set(entry.oracle_sql()) <= set(names)
    assert all(set(module.SQL) <= set(module.QUERIES) for module in modules)
