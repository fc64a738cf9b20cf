import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def listed(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    return tmp_path / "repo"


def test_library_stands_without_the_training_operators(copy):
    got = listed(copy)
    assert got.returncode == 0, got.stderr
    names = got.stdout.replace("|", " ").split()
    assert "listing_default" in names
    assert not [n for n in names if n == "pipeline" or (n.startswith("op") and n[2:3].isdigit())]


def test_what_cannot_be_imported_is_left_out_with_a_warning(copy):
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    got = listed(copy)
    assert got.returncode == 0 and "no_such_module" in got.stderr
    assert "listing_default" in got.stdout and "pipeline" not in got.stdout.split()


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
