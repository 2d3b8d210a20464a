"""The registry in copies of the repository with parts left out."""

import os
import shutil
import subprocess
import sys

import pytest

from groundswell.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print('FOUND', len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def registry_of(folder, *left_out):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "groundswell"):
        source = os.path.join(ROOT, name)
        if name in left_out or not os.path.exists(source):
            continue
        if os.path.isdir(source):
            ignored = shutil.ignore_patterns("__pycache__", *left_out)
            shutil.copytree(source, folder / name, ignore=ignored)
        else:
            shutil.copy(source, folder / name)
    return folder


def count(folder):
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True)
    found = run.stdout.rpartition("FOUND ")[2].split()
    return (int(found[0]), int(found[1]), found[2] == "True") if found else run.stderr


OWN = len(catalog.queries())


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_optional_part(tmp_path, left_out):
    assert count(registry_of(tmp_path, *left_out)) == (OWN, OWN, False)


def test_with_a_folder_left_behind(tmp_path):
    folder = registry_of(tmp_path, "llm")
    (folder / "groundswell" / "llm" / "__pycache__").mkdir(parents=True)
    assert count(folder) == (OWN, OWN, False)


def test_faults_inside_the_optional_part_surface(tmp_path):
    folder = registry_of(tmp_path, "llm", "corpus_pipeline.py")
    part = folder / "groundswell" / "llm"
    part.mkdir()
    (part / "__init__.py").write_text("")
    (part / "queries.py").write_text("import groundswell.llm.absent\n")
    assert "No module named 'groundswell.llm.absent'" in count(folder)
