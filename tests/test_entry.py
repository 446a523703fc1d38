"""The driver's contract, also without the subpackage that can be deleted."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "eps_cum5_zscore" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "tenorlake", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tenorlake").mkdir()
    for p in (ROOT / "tenorlake").iterdir():
        if p.name != "llm":
            (tmp_path / "tenorlake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
