import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_core_does_not_import_the_optional_subpackage():
    import pathlib

    for p in pathlib.Path(entry.__file__).parent.joinpath("sedgeline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "sedgeline.llm" not in p.read_text(), p
