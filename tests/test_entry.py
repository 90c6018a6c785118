"""The registry works with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = ("import __spark_entry__ as e; from scriptorium.plans import catalog as c; "
        "print(len(e.queries()) - len(c.QUERIES), set(c.QUERIES) <= set(e.queries()), "
        "set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())")
HAS_LLM = os.path.isdir(os.path.join(ROOT, "scriptorium", "llm"))
HAS_PIPELINE = os.path.isfile(os.path.join(ROOT, "corpus_pipeline.py"))


def copied(path, *without):
    shutil.copytree(ROOT, path, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *without))
    return path


def listed(repo):
    return subprocess.run([sys.executable, "-c", LIST], cwd=repo, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("without", [(), ("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_optional_parts(tmp_path, without):
    out = listed(copied(tmp_path / "repo", "tests", *without))
    assert out.returncode == 0, out.stderr
    more, core, known, pipeline = out.stdout.split()
    llm = HAS_LLM and "llm" not in without
    assert core == known == "True"
    assert (int(more) > 0) == llm
    assert (pipeline == "True") == (llm and HAS_PIPELINE and "corpus_pipeline.py" not in without)


@pytest.mark.skipif(not HAS_LLM, reason="the optional part is not there")
@pytest.mark.parametrize("library", ["xxhash", "tokenizers", "public_tokenizers"])
def test_core_queries_stay_when_a_library_is_missing(tmp_path, library):
    repo = copied(tmp_path / "repo", "tests")
    (repo / f"{library}.py").write_text(f"raise ModuleNotFoundError('not installed', name={library!r})\n")
    out = listed(repo)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "True"


@pytest.mark.skipif(not (HAS_LLM and HAS_PIPELINE), reason="the optional part is not there")
def test_a_broken_part_is_not_swallowed(tmp_path):
    repo = copied(tmp_path / "repo", "tests")
    (repo / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    out = listed(repo)
    assert out.returncode != 0 and "no_such_module_anywhere" in out.stderr


@pytest.mark.skipif(not HAS_LLM, reason="nothing to delete")
def test_the_rest_stands_with_the_optional_parts_deleted(tmp_path):
    """Both folders and the pipeline go; all other tests still import, and these here pass."""
    repo = copied(tmp_path / "repo", "llm", "corpus_pipeline.py")
    assert not (repo / "tests" / "llm").exists()
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=repo,
                                    capture_output=True, text=True, timeout=300)
    collected = run("tests", "--collect-only")
    assert collected.returncode == 0, collected.stdout[-2000:]
    out = run("tests/test_entry.py")
    assert out.returncode == 0, out.stdout[-2000:]
