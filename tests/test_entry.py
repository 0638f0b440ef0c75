"""The registry on copies of the repository that lack the parts which may be left out."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_subpackage(tmp_path, pipeline):
    """The library's own queries are there, nothing of the subpackage is, whether the pipeline's file is left or not."""
    left_out = shutil.ignore_patterns("llm", "tests", "__pycache__")
    shutil.copytree(ROOT / "inkfold", tmp_path / "inkfold", ignore=left_out)
    for name in ("__spark_entry__.py", "corpus_pipeline.py") if pipeline else ("__spark_entry__.py",):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    run = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, check=True)
    queries, sql = json.loads(run.stdout)
    assert {"newsletter", "parse_response"} <= set(queries) and set(sql) <= set(queries)
    assert not [q for q in queries if q.startswith("op") or q == "pipeline"]
