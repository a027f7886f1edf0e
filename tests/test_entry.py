"""The driver contract holds without the optional training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TELL = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'bm25_topk' in q, sum(n.startswith('op') and n[2].isdigit() for n in q))"


def told(folder):
    done = subprocess.run([sys.executable, "-c", TELL], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, sql, flagship, dealt = done.stdout.split()
    return int(n), int(sql), flagship, int(dealt)


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_imports_without_the_optional_folders(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "shelfmark", tmp_path / "shelfmark", ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    n, sql, flagship, dealt = told(tmp_path)
    assert flagship == "True" and dealt == 0 and n > 150 and sql > 150
