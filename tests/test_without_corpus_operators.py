"""The graph engine and its entry points without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_points_import(tmp_path):
    shutil.copytree(ROOT / "pathloom", tmp_path / "pathloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60 and not any(k.startswith(('op1_', 'op2_', 'op13_')) or k == 'pipeline' for k in q); print('ok')"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip() == "ok", run.stderr


def test_a_query_runs_without_them(tmp_path):
    shutil.copytree(ROOT / "pathloom", tmp_path / "pathloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["upward_rank"](spark, "/root/testdata/sf0.001").count(), e.queries()["balanced_reactions"](spark, "/root/testdata/sf0.001").count())
"""
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.stdout.startswith("rows ") and run.stdout.split()[1] != "0", run.stderr[-2000:]
    assert "the corpus operators are left out" in run.stderr


def test_a_missing_package_is_no_reason_to_leave_them_out(tmp_path):
    shutil.copytree(ROOT / "pathloom", tmp_path / "pathloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.returncode and "xxhash" in run.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "pathloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "pathloom.llm" not in path.read_text(), path
