"""The entry points have to work without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = """
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names and len(names) > 80
assert not any(n.startswith("op") or n == "pipeline" for n in names)
"""


def _copy(folder, *left_out):
    shutil.copytree(os.path.join(ROOT, "quietgrove"), folder / "quietgrove",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in {"__spark_entry__.py", "corpus_pipeline.py"} - set(left_out):
        if os.path.exists(os.path.join(ROOT, file)):
            shutil.copy(os.path.join(ROOT, file), folder / file)


def test_entry_points_without_the_training_data_part(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for i, left_out in enumerate(((), ("corpus_pipeline.py",))):
        folder = tmp_path / str(i)
        folder.mkdir()
        _copy(folder, *left_out)
        done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, timeout=120,
                              capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
