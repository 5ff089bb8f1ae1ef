"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_library_never_imports_llm():
    for p in (ROOT / "kinweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "kinweave.llm" not in p.read_text(), p


def test_entry_works_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "kinweave", tmp_path / "kinweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
