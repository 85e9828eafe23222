import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split("\n")
    return set(out[0].split()), out[1]


@pytest.mark.parametrize("left", [["corpus_pipeline.py"], []])
def test_entry_without_the_optional_parts(tmp_path, left):
    shutil.copytree(os.path.join(ROOT, "marginalia"), tmp_path / "marginalia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    names, complete = shown(tmp_path)
    assert complete == "True" and "errors_by_paper" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_other_import_errors_are_raised(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode and "marginalia" in out.stderr
