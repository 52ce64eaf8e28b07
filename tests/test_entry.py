import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["from_region", "to_region", "n"]


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_text_operators(tmp_path):
    for p in ("fauntrack", "jobs", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "fauntrack/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
