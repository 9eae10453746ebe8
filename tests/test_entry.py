import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    named = [n for n in entry.queries() if n.startswith("op")]
    if entry.llm_queries is not None:
        assert sorted(int(n[2:].split("_")[0]) for n in named) == list(range(1, len(named) + 1)) and "pipeline" in entry.queries()
    else:
        assert named == [] and "pipeline" not in entry.queries()
