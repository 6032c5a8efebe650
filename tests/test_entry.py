"""The library without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_corpus_operators(tmp_path):
    """With the subpackage gone, with or without the pipeline's module, the other queries are there; other failures show."""
    own = tmp_path / "copy"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    names = [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sorted(e.queries()))"]
    whole = eval(subprocess.run(names, cwd=own, capture_output=True, text=True, check=True).stdout)
    shutil.rmtree(own / "scholion/llm", ignore_errors=True)
    for keep in (True, False):
        if not keep:
            (own / "corpus_pipeline.py").unlink(missing_ok=True)
        rest = eval(subprocess.run(names, cwd=own, capture_output=True, text=True, check=True).stdout)
        assert rest == [q for q in whole if not (q == "pipeline" or q[:2] == "op" and q[2].isdigit())] and len(rest) > 50
    (own / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    assert subprocess.run(names, cwd=own, capture_output=True).returncode != 0
