"""Python workers get the package from the driver: nothing is installed or found by the working directory there."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from millrace.session import build
spark = build("local[2]", 2, **{{"spark.executorEnv.PYTHONPATH": ""}})
for name in ("normalize_text", "vector_topk_batch", "grounding_full", "fake_embed", "stream_breaker", "stream_recent", "chat"):
    assert entry.queries()[name](spark, {folder!r}).count() > 0, name
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), folder=FOLDER)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
