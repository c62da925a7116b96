"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_it_works_without_the_operators(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tessera/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)


def test_the_library_does_not_import_the_operators():
    for folder, _, names in os.walk(f"{ROOT}/tessera"):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    assert "tessera.llm" not in f.read(), name
