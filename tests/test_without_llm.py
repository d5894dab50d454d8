import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    assert (tmp_path / "repo" / "kinweave").is_dir() and not (tmp_path / "repo" / "tests" / "llm").exists()
    (tmp_path / "repo" / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    # The repository's own root goes from the path; packages that come by it stay.
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(kept)}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout + found.stderr
    n, has_llm = found.stdout.split()
    assert int(n) > 20 and has_llm == "False", found.stderr
    # All of the rest's tests can be collected, and some are run.
    gathered = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=200)
    assert gathered.returncode == 0, gathered.stdout + gathered.stderr
    run = [sys.executable, "-m", "pytest", "-q", "tests/test_keys.py", "tests/test_queries.py::test_registry"]
    ran = subprocess.run(run, cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=400)
    assert ran.returncode == 0 and " passed" in ran.stdout, ran.stdout


def test_a_package_that_cannot_be_imported_is_left_out(tmp_path):
    """The training-data operators are there, but something that they need isn't."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and found.stdout.split()[1] == "False" and int(found.stdout.split()[0]) > 20, found.stderr
