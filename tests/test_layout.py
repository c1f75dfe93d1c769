"""The optional subpackage can go without the rest noticing."""

import ast
import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_nothing_outside_imports_the_optional_subpackage():
    for f in (ROOT / "mentionmill").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_entry_without_the_optional_subpackage(tmp_path):
    for name in ("mentionmill", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert int(out.stdout.strip()) > 100


def run(tmp_path, code):
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_a_query_runs_without_the_optional_subpackage(tmp_path):
    for name in ("mentionmill", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = """
import __spark_entry__ as e
from mentionmill.session import build_session
spark = build_session("t", "local[2]", spark__sql__shuffle__partitions="2")
assert e.entry(spark).count() == 10
assert e.queries()["cluster_within_documents"](spark, "/root/testdata/sf0.001").count() > 0
"""
    run(tmp_path, code)


def test_a_missing_library_costs_only_the_optional_queries(tmp_path):
    for name in ("mentionmill", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / name
        if src.exists():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = """
import sys
sys.modules["public_tokenizers"] = None
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 100 and set(o) <= set(q) and not [n for n in q if n.startswith("op") or n == "pipeline"]
"""
    run(tmp_path, code)


def test_no_local_folder_on_a_cluster():
    import pytest

    from mentionmill import storage

    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert storage.shared_dir(Session()) == "hdfs://x/y"
