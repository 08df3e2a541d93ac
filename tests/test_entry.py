import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert entry.entry(spark).count() > 0


def test_core_needs_no_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "traceloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "traceloom.llm" not in p.read_text(), p
