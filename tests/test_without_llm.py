"""The library imports and lists its queries without the training-data part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_part(tmp_path):
    for name in ("__spark_entry__.py", "scholia"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "scholia" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_it():
    for path in (ROOT / "scholia").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "scholia.llm" not in path.read_text(), path
