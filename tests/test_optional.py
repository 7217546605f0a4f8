"""The library works without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_without_corpus_operators(tmp_path):
    for name in ("larkspur", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if src.is_dir() else {}))
    code = "import __spark_entry__ as e; assert 'agg_sum' in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
