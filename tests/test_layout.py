import ast
import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_outside_imports_the_text_operators():
    for path in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(re.search(r"(^|\.)llm(\.|$)", n) for n in names), path


def test_entry_names_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {"find_word", "p3_found"} <= set(queries)
    if (ROOT / "corpusloom" / "llm").exists():
        assert {f"p{n}_found" for n in range(1, 10)} <= set(queries)


def test_no_local_checkpoints():
    for path in (ROOT / "corpusloom").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text()
