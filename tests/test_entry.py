import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200


def test_core_queries_live_without_the_text_operators():
    """A library that only the text operators need is missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'public_tokenizers': raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'pagerank' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, timeout=100).returncode == 0
