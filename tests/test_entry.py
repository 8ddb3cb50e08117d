import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 90


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_llm(tmp_path):
    """With packloom/llm and tests/llm deleted, and with or without the
    pipeline's file, the rest imports and its queries are there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "*.json", "*.md", "*.txt")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    for folder in ("packloom/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "copy" / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pipeline' not in n and not any(x.startswith('op') for x in n); assert len(n) > 80; e.oracle_sql()"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")})
    run()
    (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    run()
