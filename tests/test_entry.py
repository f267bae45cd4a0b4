"""The rest works without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'frequency_list' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_llm():
    for p in (ROOT / "quernstone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quernstone.llm" not in p.read_text()
