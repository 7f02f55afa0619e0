import __spark_entry__ as E


def test_names_and_sql():
    names = set(E.queries())
    assert {"p2_found", "p2_hierarchy"} <= names
    assert set(E.oracle_sql()) <= names


def test_flagship(spark):
    assert E.entry(spark).columns == ["id", "root", "depth", "path", "n_descendants"]
