import ast
import importlib.util
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_training_operators():
    for path in (ROOT / "recollex").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_entry_without_the_training_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None)
    assert entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert "pipeline" not in entry.queries()
