"""The library without its optional part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import sys
import __spark_entry__ as entry
names = set(entry.queries())
assert "r8_report" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names), names
assert set(entry.oracle_sql()) <= names
assert not any(m.startswith("palisade.llm") or m == "corpus_pipeline" for m in sys.modules)
print(len(names))
"""


def copy_without_llm(to: str, pipeline: bool) -> None:
    shutil.copytree(f"{ROOT}/palisade", f"{to}/palisade", ignore=lambda folder, names: ["__pycache__", *(["llm"] if folder.endswith("palisade") else [])])
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])]:
        shutil.copy(f"{ROOT}/{name}", to)


def test_imports_without_the_training_data_operators(tmp_path):
    for i, pipeline in enumerate((True, False)):
        to = tmp_path / str(i)
        to.mkdir()
        copy_without_llm(str(to), pipeline)
        done = subprocess.run([sys.executable, "-c", PROBE], cwd=to, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(to)}, timeout=120)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout) > 100


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(f"{ROOT}/palisade"):
        if "llm" not in os.path.relpath(folder, ROOT).split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "palisade.llm" not in f.read(), name
