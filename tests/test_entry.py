from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["point_id", "pool", "horizon", "status", "end_id", "net_return_bps", "price_change_bps", "price_level_bps", "history_available", "partition"]


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_removable_part():
    root = Path(__file__).resolve().parents[1]
    others = [p for p in (root / "tidemark").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "tidemark.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]


def test_entry_without_the_removable_part(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100 and not [n for n in q if n.startswith('op1_')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
