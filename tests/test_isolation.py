"""The training-data operators stand apart: nothing else imports them, and all else works without them."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imported(path):
    """Full names of all that a module imports, relative ones resolved."""
    package = path.relative_to(ROOT).with_suffix("").parts[:-1]
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = ".".join(package[: len(package) - node.level + 1]) if node.level else ""
            module = ".".join(x for x in (base, node.module) if x)
            yield from (f"{module}.{a.name}" for a in node.names)


def test_nothing_else_imports_them():
    for path in [*(ROOT / "graphloom").rglob("*.py"), *(ROOT / "tests").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [n for n in imported(path) if "llm" in n.split(".") or n.startswith("corpus_pipeline")], path


def test_the_rest_works_without_them(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[-2:] == ["False", "False"] and int(out.stdout.split()[-3]) > 30
    tests = ["tests/test_parsers.py", "tests/test_commonmark.py", "tests/test_recovery.py", "tests/test_columns.py"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *tests], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, check=True)
