"""The driver's contract, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 497
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


def test_works_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", ".git", "readloom"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "readloom")
    for name in os.listdir(f"{ROOT}/readloom"):
        if name != "llm":
            os.symlink(f"{ROOT}/readloom/{name}", tmp_path / "readloom" / name)
    code = "import os, sys; sys.path.insert(0, os.getcwd()); import __spark_entry__ as e; q = e.queries(); assert 'raw_summits' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q.keys(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
