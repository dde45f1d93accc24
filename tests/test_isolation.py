"""The library without its removable part."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_removable_folders(tmp_path, pipeline):
    """All other queries stay, whether or not the pipeline's file goes with its folders."""
    shutil.copytree(f"{ROOT}/pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, oracles = json.loads(done.stdout)

    from pagemill.catalog import ORACLES, QUERIES

    assert queries == sorted(QUERIES) and oracles == sorted(ORACLES)
