"""The entry point with and without the corpus package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e, bench, check; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {**os.environ, "PYTHONPATH": folder}
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split())


def test_the_rest_registers_without_the_corpus_package(tmp_path):
    from pigeonhole.plans import registry

    for hidden in (("pigeonhole/llm",), ("pigeonhole/llm", "corpus_pipeline.py")):
        folder = tmp_path / str(len(hidden))
        shutil.copytree(ROOT, folder, ignore=lambda d, found: [x for x in found if x.startswith(".") or x == "__pycache__" or os.path.relpath(os.path.join(d, x), ROOT) in hidden])
        assert names(str(folder)) == set(registry.queries())


def test_errors_inside_the_corpus_package_are_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".*", "__pycache__"))
    if not (tmp_path / "repo/pigeonhole/llm").is_dir():
        return
    (tmp_path / "repo/pigeonhole/llm/queries.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr
