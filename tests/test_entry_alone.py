"""The entry file without the corpus operators: a copy of the repository that lacks their two folders."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).parent.parent
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_other_queries_stay(tmp_path, pipeline):
    from lineloom.plans.catalog import QUERIES

    shutil.copytree(ROOT / "lineloom", tmp_path / "lineloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        shutil.copy(ROOT / name, tmp_path / name)
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(QUERIES)), "False"]
