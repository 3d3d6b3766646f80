import __spark_entry__


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_corpus_package():
    from pathlib import Path

    for p in (Path(__spark_entry__.__file__).parent / "tablekeel").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tablekeel.llm" not in p.read_text(), p
