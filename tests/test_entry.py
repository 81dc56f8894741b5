"""The driver's entry points, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lodestone import catalog

REPO = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e, bench; print(len(e.queries()), len(e.oracle_sql()), all(k in e.queries() for k in e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("gone", [("lodestone/llm", "tests/llm"), ("lodestone/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_corpus_operators(tmp_path, gone):
    at = tmp_path / "repo"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        if (at / name).is_dir():
            shutil.rmtree(at / name)
        elif (at / name).exists():
            (at / name).unlink()
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=at, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    queries, oracles, known, pipeline = said.stdout.split()
    assert (known, pipeline) == ("True", "False")
    if (at / "lodestone/llm").exists():
        assert int(queries) > len(catalog.queries())
    else:
        assert (int(queries), int(oracles)) == (len(catalog.queries()), len(catalog.oracle_sql()))


def test_faults_of_present_modules_show(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (at / "corpus_pipeline.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=at, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "no_such_module" in said.stderr
