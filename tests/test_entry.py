"""The entry point with and without the optional corpus part."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder: str) -> tuple[set[str], set[str]]:
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True, timeout=300)
    queries, sql = json.loads(done.stdout.splitlines()[-1])
    return set(queries), set(sql)


def copy_of_repository(to: str, *left_out: str) -> str:
    def ignored(folder: str, entries: list[str]) -> set[str]:
        inside = os.path.relpath(folder, ROOT)
        return {e for e in entries if os.path.normpath(os.path.join(inside, e)) in left_out or e in (".git", "__pycache__")}

    return str(shutil.copytree(ROOT, to, ignore=ignored))


@pytest.mark.parametrize(
    "left_out", [("ampledger/llm", "tests/llm"), ("ampledger/llm", "tests/llm", "corpus_pipeline.py")], ids=["operators", "both"]
)
def test_without_corpus_operators(tmp_path, left_out):
    queries, sql = names(copy_of_repository(tmp_path / "copy", *left_out))
    assert not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries
    assert {"flagship_low_consumers", "m14_many_labels", "x3_upload_run"} <= queries
    assert len(queries) > 190 and sql <= queries


def test_without_pipeline_only(tmp_path):
    queries, _ = names(copy_of_repository(tmp_path / "copy", "corpus_pipeline.py"))
    assert "pipeline" not in queries and len(queries) > 190
